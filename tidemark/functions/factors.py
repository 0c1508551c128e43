"""Factor expressions: up to three predicates joined by ``&``, compiled to Spark columns.

    expression = predicate (" & " predicate)*      one to three
    predicate  = atom comparator (atom | number)
    atom       = column ("__" transform)*

Transforms are ``zs<window>`` and ``rank<window>`` (1h 2h 12h 24h 3d 7d), ``lag<n>``,
``abs`` and ``sign``. A name that the frame holds as a whole is that column.
"""

from __future__ import annotations

import re
from collections.abc import Collection, Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

#: Rows per hour of the event spine.
ROWS_PER_HOUR = 12
WINDOWS = {"1h": 1, "2h": 2, "12h": 12, "24h": 24, "3d": 72, "7d": 168}
#: Least values that a window needs; a shorter window needs a sixth of its rows.
LEAST = {"24h": 50, "7d": 200}
MOST_PREDICATES = 3
COMPARATORS = ("<=", ">=", "==", "!=", "<", ">")

_compare = re.compile(r" ?(<=|>=|==|!=|<|>) ?")
_number = re.compile(r"-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?")
_step = re.compile(r"(?P<name>zs|rank|lag|abs|sign)(?P<arg>[0-9]+[a-z]?)?")


class FactorError(ValueError):
    pass


@dataclass(frozen=True)
class Atom:
    column: str
    steps: tuple[tuple[str, str | None], ...] = ()


@dataclass(frozen=True)
class Predicate:
    left: Atom
    comparator: str
    right: Atom | float


@dataclass(frozen=True)
class Factor:
    text: str
    predicates: tuple[Predicate, ...] = field(default=())

    @property
    def columns(self) -> set[str]:
        """Base columns that the factor reads: what a plan must provide."""
        atoms = [a for p in self.predicates for a in (p.left, p.right) if isinstance(a, Atom)]
        return {a.column for a in atoms}


def canonicalize(text: str) -> str:
    """The one spelling of an expression: single spaces, `` & ``, none around comparators."""
    parts = [" ".join(part.split()) for part in text.split("&")]
    return " & ".join(_compare.sub(r"\1", part) for part in parts)


def _atom(token: str, known: Collection[str]) -> Atom:
    if token in known:
        return Atom(token)
    column, *steps = token.split("__")
    if column not in known:
        raise FactorError(f"no such column: {column!r}")
    found = []
    for step in steps:
        match = _step.fullmatch(step)
        if not match:
            raise FactorError(f"no such transform: {step!r}")
        name, arg = match["name"], match["arg"]
        if name in ("abs", "sign"):
            wrong = arg is not None
        elif name == "lag":
            wrong = arg is None or not arg.isdigit()
        else:
            wrong = arg not in WINDOWS
        if wrong:
            raise FactorError(f"bad argument of {name}: {arg!r}")
        found.append((name, arg))
    return Atom(column, tuple(found))


def parse(text: str, known: Collection[str]) -> Factor:
    """The factor that ``text`` spells over the columns ``known``; raises ``FactorError``."""
    if not text or not text.strip():
        raise FactorError("the expression is empty")
    canonical = canonicalize(text)
    parts = canonical.split(" & ")
    if len(parts) > MOST_PREDICATES:
        raise FactorError(f"{len(parts)} predicates; {MOST_PREDICATES} at most")
    predicates = []
    for part in parts:
        comparator = next((c for c in COMPARATORS if c in part), None)
        if comparator is None:
            raise FactorError(f"no comparator in {part!r}")
        left, _, right = part.partition(comparator)
        left, right = left.strip(), right.strip()
        value = float(right) if _number.fullmatch(right) else _atom(right, known)
        predicates.append(Predicate(_atom(left, known), comparator, value))
    return Factor(canonical, tuple(predicates))


def _window(arg: str) -> tuple[int, int]:
    rows = WINDOWS[arg] * ROWS_PER_HOUR
    return rows, LEAST.get(arg, max(2, rows // 6))


def compile_atom(atom: Atom, order: Iterable[str], partition: Iterable[str] = ()) -> Column:
    """The atom as a column over rows in ``order`` (per ``partition``), missing as null."""
    value = F.col(f"`{atom.column}`").cast("double")
    value = F.nanvl(value, F.lit(None).cast("double"))
    ordered = Window.partitionBy(*partition).orderBy(*order)
    for name, arg in atom.steps:
        if name == "abs":
            value = F.abs(value)
        elif name == "sign":
            value = F.signum(value)
        elif name == "lag":
            value = F.lag(value, int(arg)).over(ordered)
        else:
            from tidemark.operators.rolling import percentile_rank, zscore

            value = (zscore if name == "zs" else percentile_rank)(value, ordered, *_window(arg))
    return value


def compile_predicate(p: Predicate, order: Iterable[str] = (), partition: Iterable[str] = ()) -> Column:
    """True or false, never null: a missing operand misses, except that ``!=`` then hits."""
    left = compile_atom(p.left, order, partition)
    right = F.lit(p.right) if isinstance(p.right, float) else compile_atom(p.right, order, partition)
    if p.comparator == "!=":
        return left.isNull() | right.isNull() | (left != right)
    hit = {"<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right, "==": left == right}[p.comparator]
    return F.coalesce(hit, F.lit(False))


def compile_factor(factor: Factor, order: Iterable[str] = (), partition: Iterable[str] = ()) -> Column:
    hit = F.lit(True)
    for p in factor.predicates:
        hit = hit & compile_predicate(p, order, partition)
    return hit


def reach(factors: Iterable[Factor]) -> int:
    """How many rows back the transforms of any atom look; 0 without windows."""
    atoms = [a for f in factors for p in f.predicates for a in (p.left, p.right) if isinstance(a, Atom)]
    back = {"lag": int, "zs": lambda arg: _window(arg)[0], "rank": lambda arg: _window(arg)[0]}
    return max((sum(back[name](arg) for name, arg in a.steps if name in back) for a in atoms), default=0)


def hits(df: DataFrame, factors: Iterable[str], keys: Iterable[str], order: str | None = None, rows: int = 20_000, span: int = 86_400 * 30) -> DataFrame:
    """``keys, factor, hit``: every factor over every row in long form, in one pass of ``df``.

    Transforms that look back need ``order``, a unique column of times in seconds; their
    windows run in buckets of ``rows`` rows, each with as many rows of the one before as
    they reach.
    """
    parsed = [parse(f, df.columns) for f in factors]
    back = reach(parsed)
    if back:
        from tidemark.operators.timeline import in_buckets

        if order is None:
            raise FactorError("transforms that look back need an order")
        df = in_buckets(df, order, back, rows, span)
    pairs = [F.struct(F.lit(f.text).alias("factor"), compile_factor(f, ["_idx"], ["_bucket"]).alias("hit")) for f in parsed]
    found = df.select(*keys, *(["_own"] if back else []), F.array(*pairs).alias("f"))
    found = found.where("_own") if back else found
    return found.select(*keys, F.explode("f").alias("f")).select(*keys, "f.factor", "f.hit")


def _masks(predicates: Sequence[Predicate], names: dict[Atom, int]):
    """The hits of each predicate over a batch whose columns are the atoms' values, missing as NaN."""
    compare = {"<": np.less, "<=": np.less_equal, ">": np.greater, ">=": np.greater_equal, "==": np.equal}

    def run(values: list[np.ndarray]) -> np.ndarray:
        out = np.empty((len(predicates), len(values[0])), bool)
        for i, p in enumerate(predicates):
            left = values[names[p.left]]
            right = p.right if isinstance(p.right, float) else values[names[p.right]]
            # NaN is unequal to everything and never less, equal or greater
            out[i] = left != right if p.comparator == "!=" else compare[p.comparator](left, right)
        return out

    return run


def roster_hits(df: DataFrame, factors: Iterable[str], keys: Sequence[str], order: str | None = None, rows: int = 20_000, span: int = 86_400 * 30) -> DataFrame:
    """``keys, factor`` where a factor hits, for rosters of thousands; ``hits`` with ``hit`` true.

    The plan has a column for each distinct atom (a base column with its transforms). Per
    Arrow batch each distinct predicate is evaluated once into a row of bits, and a factor is
    the product of the rows that its predicate ids name, so factors cost neither expressions
    nor rows where they miss. Equal spellings of a factor give it once.
    """
    parsed = list({f.text: f for f in (parse(f, df.columns) for f in factors)}.values())
    back = reach(parsed)
    if back:
        from tidemark.operators.timeline import in_buckets

        if order is None:
            raise FactorError("transforms that look back need an order")
        df = in_buckets(df, order, back, rows, span)
    predicates = list(dict.fromkeys(p for f in parsed for p in f.predicates))
    atoms = list(dict.fromkeys(x for p in predicates for x in (p.left, p.right) if isinstance(x, Atom)))
    number = {p: i for i, p in enumerate(predicates)}
    ids = [[number[p] for p in f.predicates] for f in parsed]
    masks, texts = _masks(predicates, {x: i for i, x in enumerate(atoms)}), pa.array([f.text for f in parsed])
    found = df.select(*keys, *(["_own"] if back else []), *[compile_atom(x, ["_idx"], ["_bucket"]).alias(f"_a{i}") for i, x in enumerate(atoms)])
    found = found.where("_own").drop("_own") if back else found
    count = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4_096):
                batch = whole.slice(at, 4_096)
                bits = masks([c.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False) for c in batch.columns[count:]])
                which, where, held = [], [], 0
                for i, of in enumerate(ids):
                    hit = np.flatnonzero(bits[of].all(axis=0))
                    which.append(np.full(len(hit), i))
                    where.append(hit)
                    held += len(hit)
                    if held >= 1 << 18 or i == len(ids) - 1:
                        rows_, names = pa.array(np.concatenate(where)), texts.take(pa.array(np.concatenate(which)))
                        yield pa.record_batch([*[c.take(rows_) for c in batch.columns[:count]], names], names=[*keys, "factor"])
                        which, where, held = [], [], 0

    schema = StructType([*found.select(*keys).schema.fields, StructField("factor", StringType())])
    return found.mapInArrow(run, schema)


def needs_source(factor: Factor, prefixes: Iterable[str]) -> bool:
    """Whether the factor reads a column of a source, by its columns' prefixes."""
    return any(c.startswith(tuple(prefixes)) for c in factor.columns)


# transforms that a realtime row can compute from history: 24h and 7d scores and the daily rank
REALTIME_STEPS = {("zs", "24h"), ("zs", "7d"), ("rank", "24h")}


def realtime_plan(factor: Factor, computable: Iterable[str] = ("bn_",)) -> set[str]:
    """The base columns that a realtime row must compute; raises for those it cannot."""
    needed = set()
    for p in factor.predicates:
        for atom in (p.left, p.right):
            if not isinstance(atom, Atom):
                continue
            base, *steps = atom.column.split("__")
            chain = [(m["name"], m["arg"]) for s in steps if (m := _step.fullmatch(s))] + list(atom.steps)
            if not base.startswith(tuple(computable)) or any(step not in REALTIME_STEPS for step in chain):
                raise NotImplementedError(f"not computable in real time: {atom.column!r}")
            needed.add(base)
    return needed
