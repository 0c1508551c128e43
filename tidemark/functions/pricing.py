"""Prices to money: taker fee, friction, profit ratios, order sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The venue's fee rate per market category.
FEE_RATES = {
    "Crypto": 0.07,
    "Sports": 0.03,
    "Finance": 0.04,
    "Politics": 0.04,
    "Mentions": 0.04,
    "Tech": 0.04,
    "Economics": 0.05,
    "Culture": 0.05,
    "Weather": 0.05,
    "Other": 0.05,
    "General": 0.05,
    "Geopolitics": 0.00,
}
DEFAULT_RATE = FEE_RATES["Crypto"]
# Fixed value: how much worse than the sampled price an entry is assumed to be.
DRIFT = 0.015

LEAST_ORDER = 1.0
HIGHEST_LIMIT = 0.99


def fee_ratio(price: Column, rate: Column | float = DEFAULT_RATE) -> Column:
    """Fee per unit invested; a cheaper entry buys more shares and pays more."""
    return (rate if isinstance(rate, Column) else F.lit(float(rate))) * (F.lit(1.0) - price)


def category_rate(category: Column) -> Column:
    """The category's rate; null for unknown ones."""
    return F.create_map(*[F.lit(x) for pair in FEE_RATES.items() for x in pair])[category]


def paper_friction(price: Column, rate: float = DEFAULT_RATE) -> Column:
    return fee_ratio(price, rate)


def backtest_friction(price: Column, rate: float = DEFAULT_RATE, drift: float = DRIFT) -> Column:
    return fee_ratio(price + F.lit(drift), rate)


def friction_breakdown(price: Column, context: str, rate: float = DEFAULT_RATE) -> Column:
    """``fee``, ``drift_fee_delta`` and ``total`` as a struct; contexts are paper and backtest."""
    fee = fee_ratio(price, rate)
    if context == "paper":
        delta = F.lit(0.0)
    elif context == "backtest":
        delta = backtest_friction(price, rate) - fee
    else:
        raise ValueError(f"no such friction context: {context!r}")
    return F.struct(fee.alias("fee"), delta.alias("drift_fee_delta"), (fee + delta).alias("total"))


def side_won(direction: Column, up_won: Column) -> Column:
    """True if the side that was bought won; null while the outcome is unknown."""
    return F.when(up_won.isNotNull(), F.when(direction == "UP", up_won == 1).when(direction == "DOWN", up_won == 0).otherwise(F.lit(False)))


def gross_ratio(won: Column, price: Column) -> Column:
    """Profit per unit before fees: (1-p)/p on a win, -1 on a loss."""
    return F.when(won.isNull() | price.isNull(), F.lit(None).cast("double")).when(won, F.try_divide(F.lit(1.0) - price, price)).otherwise(F.lit(-1.0))


def net_ratio(won: Column, price: Column, rate: float = DEFAULT_RATE) -> Column:
    return gross_ratio(won, price) - fee_ratio(price, rate)


def order_size(balance: Column, fraction: Column) -> Column:
    """Balance share in whole cents, half to even; null below the least order."""
    size = F.bround(balance * fraction, 2)
    return F.when(size >= LEAST_ORDER, size)


def price_limit(price: Column, cap: Column) -> Column:
    return F.least(F.lit(HIGHEST_LIMIT), F.bround(price + cap, 2))
