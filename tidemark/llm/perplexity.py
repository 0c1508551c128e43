"""Quality rules: counts over whole texts, and the perplexity of an n-gram model in bands per language.

The model gives each word its chance, letter by letter: n-grams of characters within a word
(with its two ends), smoothed by modified Kneser-Ney, one model per language. Spark counts
the distinct words of all documents, then their n-grams weighted by the words' counts, then
continuations, discounts and interpolated chances order by order. The model is one sorted
array of hashes with a value each, cut into files by ranges of hashes. A task scores the
distinct words of its documents against one file after the other, so neither memory nor
driver ever hold a model.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import discard, filesystem, free_name, hot_join, materialize, plain_text, qualified, release, released, shared_dir

#: Characters of the longest n-gram.
ORDER = 5
#: Distinct words that a counting task holds, n-grams of a model file, bytes of text that are scored at a time.
HELD_WORDS, FILE_ROWS, BLOCK_BYTES = 1 << 20, 1 << 20, 128 << 20
#: Words whose n-grams are looked at together.
SLICE = 1 << 16
#: At most so many languages' figures are broadcast.
BROADCAST_LANGS = 100_000
#: What stands before and behind a word, and so in no word.
START, END = " ", "\n"
#: Half the width of a band in spreads, and the least spread in bits per word.
BAND, LEAST_SPREAD = 4.5, 0.1
#: Documents of fewer words fail.
LEAST_WORDS = 50

WORDS = "lang string, word string, n long"
_WORDS = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the distinct words of a task's rows (lang, text in UTF-8)."""
    held: dict[str, Counter] = defaultdict(Counter)

    def close() -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            words, n = list(counts), list(counts.values())
            for at in range(0, len(words), 1 << 16):
                part = slice(at, at + (1 << 16))
                yield pa.record_batch([pa.array([lang] * len(n[part])), pa.array(words[part], pa.binary()).cast(pa.string()), pa.array(n[part], pa.int64())], schema=_WORDS)
        held.clear()

    for batch in batches:
        for lang, text in zip(*batch.columns, strict=True):
            held[lang.as_py()].update(text.as_py().split())  # at the six ASCII white spaces
        if sum(map(len, held.values())) >= HELD_WORDS:
            yield from close()
    yield from close()


def characters(text: str) -> np.ndarray:
    """Code points; 0, which pads n-grams, is read as 1."""
    found = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    return np.where(found == 0, np.uint64(1), found)


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of padded words, one after the other, and where each word begins, with the end of all."""
    return characters("".join(f"{START}{w}{END}" for w in words)), np.cumsum([0] + [len(w) + 2 for w in words])


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def lang_seed(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=7).digest()) << 2)


def gram_keys(chars: np.ndarray, seed: np.ndarray | np.uint64, length: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the ``length[i]`` characters up to and with place ``ends[i]``; ``seed`` tells languages and kinds apart."""
    h = np.broadcast_to(np.asarray(seed, np.uint64), ends.shape).copy()
    longest = int(length.max()) if len(length) else 0
    for back in range(longest - 1, -1, -1):
        inside = back < length
        h = np.where(inside, _mix(h * np.uint64(0x100000001B3) + chars[np.where(inside, ends - back, 0)]), h)
    return _mix(h + length.astype(np.uint64))


def positions(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all characters that are predicted (all but the words' starts), and how many characters of the word lie up to each."""
    inside = np.arange(starts[-1]) - np.repeat(starts[:-1], np.diff(starts))
    places = np.flatnonzero(inside > 0)
    return places, inside[places] + 1


GRAMS = "lang string, gram string, n long"
_GRAMS = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())])


def _grams(order: int):
    """For each character of each word the longest n-gram that ends there, counted within slices of words."""

    def count(lang: str, words: list[str], n: list[int]) -> pa.RecordBatch:
        chars, starts = code_points(words)
        ends, seen = positions(starts)
        length = np.minimum(seen, order)
        _, first, place = np.unique(gram_keys(chars, np.uint64(0), length, ends), return_index=True, return_inverse=True)
        total = np.zeros(len(first), np.int64)
        np.add.at(total, place, np.repeat(np.array(n, np.int64), np.diff(starts) - 1))
        back = np.arange(order)
        of = ends[first, None] - length[first, None] + 1 + back
        letters = np.where(back < length[first, None], chars[np.minimum(of, len(chars) - 1)], 0).astype(np.uint32)
        grams = np.ascontiguousarray(letters).view(f"<U{order}").ravel()
        return pa.record_batch([pa.array([lang] * len(grams)), pa.array(grams.tolist(), pa.string()), pa.array(total)], schema=_GRAMS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, tuple[list[str], list[int]]] = defaultdict(lambda: ([], []))
        held = 0
        for batch in batches:
            for lang, word, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                words, counts = waiting[lang]
                words.append(word)
                counts.append(n)
                held += 1
                if held >= SLICE:
                    yield from (count(k, *v) for k, v in waiting.items())
                    waiting.clear()
                    held = 0
        yield from (count(k, *v) for k, v in waiting.items())

    return run


def gram_counts(spark: SparkSession, words: DataFrame, order: int) -> list[DataFrame]:
    """Tables ``lang, gram, a`` of the n-grams of 1 to ``order`` characters with their counts.

    The longest count as often as they occur, and so do those that begin a word, as nothing
    can stand before them; shorter ones count the different characters that stand before them.
    """
    found = words.mapInArrow(released(_grams(order)), GRAMS).groupBy("lang", "gram").agg(F.sum("n").alias("a"))
    found = materialize(spark, found, "lm-grams")
    levels = [found.where(F.char_length("gram") == order)]
    for k in range(order - 1, 0, -1):
        before = levels[0].groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("a"))
        here = found.where(F.char_length("gram") == k) if k > 1 else found.limit(0)
        levels.insert(0, materialize(spark, before.unionByName(here), f"lm-level-{k}"))
    return levels


def discounts(level: DataFrame) -> DataFrame:
    """``lang, d1, d2, d3``: what modified Kneser-Ney takes from counts of 1, 2 and more.

    From the numbers of n-grams that count 1 to 4; where a language has too few of them,
    half a unit for each step. Some of each is always taken, so nothing is impossible.
    """
    n = level.groupBy("lang").agg(*[F.count_if(F.col("a") == i).cast("double").alias(f"n{i}") for i in range(1, 5)])
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
    share = [F.lit(float(i)) - (i + 1) * y * F.try_divide(F.col(f"n{i + 1}"), F.col(f"n{i}")) for i in (1, 2, 3)]
    return n.select("lang", *[F.least(F.greatest(F.coalesce(d, F.lit(i / 2)), F.lit(0.05)), F.lit(float(i) - 0.05)).alias(f"d{i}") for i, d in zip((1, 2, 3), share, strict=True)])


def chances(spark: SparkSession, levels: list[DataFrame]) -> list[DataFrame]:
    """Tables ``lang, gram, p, rest`` for each length: the interpolated chance of an n-gram's last
    character after the others, and what those others leave to shorter contexts."""
    out: list[DataFrame] = []
    for k, level in enumerate(levels, 1):
        context = Window.partitionBy("lang", "context")
        rows = level.withColumn("context", F.substring("gram", 1, k - 1) if k > 1 else F.lit(""))
        rows = rows.withColumns({
            "total": F.sum("a").over(context),
            "n1": F.count_if(F.col("a") == 1).over(context),
            "n2": F.count_if(F.col("a") == 2).over(context),
            "n": F.count("*").over(context),
        })
        rows = hot_join(spark, rows, discounts(level), ["lang"], ["gram"], BROADCAST_LANGS)
        own = F.when(F.col("a") == 1, F.col("d1")).when(F.col("a") == 2, F.col("d2")).otherwise(F.col("d3"))
        rest = (F.col("d1") * F.col("n1") + F.col("d2") * F.col("n2") + F.col("d3") * (F.col("n") - F.col("n1") - F.col("n2"))) / F.col("total")
        rows = rows.select("lang", "gram", "context", "n", ((F.col("a") - own) / F.col("total")).alias("u"), rest.alias("rest"))
        if k == 1:  # below single characters: all of the language's, and one for those never seen
            rows = rows.withColumn("below", F.lit(1.0) / (F.col("n") + 1))
        else:
            shorter = out[-1].select("lang", F.col("gram").alias("suffix"), F.col("p").alias("below"))
            rows = rows.withColumn("suffix", F.expr("substring(gram, 2)")).join(shorter, ["lang", "suffix"])
        out.append(materialize(spark, rows.select("lang", "gram", "context", "rest", (F.col("u") + F.col("rest") * F.col("below")).alias("p"), "below"), f"lm-chances-{k}"))
    return out


#: What a row of the model stands for: an n-gram's chance, what a context leaves, a character never seen.
GRAM, REST, UNSEEN = 0, 1, 2


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lang, kind, gram, value = batch.columns
        grams = gram.to_pylist()
        chars = characters("".join(grams))
        length = np.array([len(g) for g in grams], np.int64)
        codes = lang.dictionary_encode()
        seeds = np.array([lang_seed(x) for x in codes.dictionary.to_pylist()], np.uint64)[codes.indices.to_numpy()] + kind.to_numpy().astype(np.uint64)
        yield pa.record_batch([pa.array(gram_keys(chars, seeds, length, np.cumsum(length) - 1).view(np.int64)), pa.array(np.log2(value.to_numpy()), pa.float32())], names=["key", "value"])


@dataclass
class Model:
    """A language model on files: sorted 64-bit hashes of n-grams and contexts, and a logarithm for each."""

    folder: str
    files: list[str]
    order: int


def fit(spark: SparkSession, docs: DataFrame, order: int = ORDER, file_rows: int = FILE_ROWS) -> Model:
    """Count and smooth a model of the words of all ``docs`` (columns lang and text).

    Nothing is sampled or cut. Words are first counted within tasks, so no word or language
    is hot; a language's n-grams are spread by n-gram. The files have ``file_rows`` rows each.
    """
    rows = docs.select(plain_text("lang").alias("lang"), plain_text("text").cast("binary").alias("text"))
    words = materialize(spark, rows.mapInArrow(released(_distinct_words), WORDS).groupBy("lang", "word").agg(F.sum("n").alias("n")), "lm-words")
    levels = gram_counts(spark, words, order)
    tables = chances(spark, levels)
    parts = [t.select("lang", F.lit(GRAM).alias("kind"), "gram", F.col("p").alias("value")) for t in tables]
    parts += [t.groupBy("lang", "context").agg(F.first("rest").alias("value")).select("lang", F.lit(REST).alias("kind"), F.col("context").alias("gram"), "value") for t in tables]
    parts.append(tables[0].groupBy("lang").agg(F.first(F.col("rest") * F.col("below")).alias("value")).select("lang", F.lit(UNSEEN).alias("kind"), F.lit("").alias("gram"), "value"))
    model = parts[0]
    for part in parts[1:]:
        model = model.unionByName(part)
    model = materialize(spark, model.mapInArrow(_keys, "key long, value float"), "lm-model")
    folder, files = shared_dir(spark, "lm-arrays"), max(1, -(-model.count() // file_rows))
    model.repartitionByRange(files, "key").sortWithinPartitions("key").write.parquet(folder)
    discard(spark, words, *levels[:-1], *tables, model)
    return Model(qualified(spark, folder), sorted(spark.read.parquet(folder).inputFiles()), order)


class Arrays:
    """The model's files, read one at a time."""

    def __init__(self, model: Model):
        self.files, _ = filesystem(model.folder)
        self.paths = [filesystem(f)[1] for f in model.files]

    def values(self, keys: np.ndarray) -> np.ndarray:
        """The values of sorted, distinct ``keys``; NaN for those that the model lacks."""
        out = np.full(len(keys), np.nan, np.float32)
        for path in self.paths:
            with self.files.open_input_file(path) as f:
                table = pq.ParquetFile(f).read()
            here, value = table["key"].to_numpy(), table["value"].to_numpy()
            if not len(here):
                continue
            low, high = np.searchsorted(keys, here[0]), np.searchsorted(keys, here[-1], "right")
            at = np.searchsorted(here, keys[low:high])
            out[low:high] = np.where(here[at] == keys[low:high], value[at], out[low:high])
        return out

    def of(self, keys: np.ndarray) -> np.ndarray:
        distinct, place = np.unique(keys, return_inverse=True)
        return self.values(distinct)[place]


def word_bits(arrays: Arrays, order: int, words: dict[str, list[bytes]]) -> dict[str, np.ndarray]:
    """``-log2`` of the chance of each word, for the words of each language.

    Words are looked at in slices, their n-grams sought together. Where the model lacks an
    n-gram, the context's rest and the next shorter n-gram take its place.
    """
    slices = [(lang, at) for lang, listed in words.items() for at in range(0, len(listed), SLICE)]

    def grams(lang: str, at: int):
        chars, starts = code_points([w.decode() for w in words[lang][at : at + SLICE]])
        ends, seen = positions(starts)
        return chars, starts, ends, np.minimum(seen, order)

    # of each slice its distinct n-grams, which of them each place has, and where words begin
    held = []
    for lang, at in slices:
        chars, starts, ends, length = grams(lang, at)
        distinct, place = np.unique(gram_keys(chars, lang_seed(lang) + np.uint64(GRAM), length, ends).view(np.int64), return_inverse=True)
        held.append((distinct, place.astype(np.int32), starts))
    wanted = np.unique(np.concatenate([h[0] for h in held])) if held else np.empty(0, np.int64)
    known = arrays.values(wanted)
    out = {lang: np.zeros(len(listed)) for lang, listed in words.items()}
    for (lang, at), (distinct, place, starts) in zip(slices, held, strict=True):
        bits = -known[np.searchsorted(wanted, distinct)].astype(np.float64)[place]
        if (lacking := np.flatnonzero(np.isnan(bits))).size:
            chars, _, ends, length = grams(lang, at)
            bits[lacking] = _backed_off(arrays, lang, chars, ends[lacking], length[lacking])
        out[lang][at : at + SLICE] = np.add.reduceat(bits, starts[:-1] - np.arange(len(starts) - 1))
    return out


def _backed_off(arrays: Arrays, lang: str, chars: np.ndarray, ends: np.ndarray, length: np.ndarray) -> np.ndarray:
    """``-log2`` of the chances of places whose longest n-gram the model lacks."""
    seed, bits = lang_seed(lang), np.zeros(len(ends))
    open_ = np.arange(len(ends))
    length = length.copy()
    while open_.size:
        rest = arrays.of(gram_keys(chars, seed + np.uint64(REST), length[open_] - 1, ends[open_] - 1).view(np.int64))
        bits[open_] -= np.nan_to_num(rest)  # a context never seen leaves all
        length[open_] -= 1
        single = open_[length[open_] == 0]
        if single.size:
            unseen = arrays.of(gram_keys(chars, seed + np.uint64(UNSEEN), np.zeros(1, np.int64), np.zeros(1, np.int64)).view(np.int64))[0]
            # the rest of the empty context is part of that figure; a language without words has no figure
            bits[single] += np.nan_to_num(arrays.of(gram_keys(chars, seed + np.uint64(REST), np.zeros(1, np.int64), np.zeros(1, np.int64)).view(np.int64))[0])
            bits[single] += 16.0 if np.isnan(unseen) else -unseen
            open_ = open_[length[open_] > 0]
            if not open_.size:
                break
        found = arrays.of(gram_keys(chars, seed + np.uint64(GRAM), length[open_], ends[open_]).view(np.int64))
        has = ~np.isnan(found)
        bits[open_[has]] -= found[has]
        open_ = open_[~has]
    return bits


def repeated_words(ids: np.ndarray) -> int:
    """Words in windows of three that occur twice or more, the first included."""
    if len(ids) < 4:
        return 0
    width = int(ids.max()) + 1
    _, pair = np.unique(ids[:-2] * width + ids[1:-1], return_inverse=True)
    _, place, times = np.unique(pair * width + ids[2:], return_inverse=True, return_counts=True)
    again = times[place] > 1
    covered = np.zeros(len(ids), bool)
    for i in range(3):
        covered[i : len(ids) - 2 + i] |= again
    return int(covered.sum())


_SPACES, _SYMBOLS, _FOLLOWING = b" \t\n\x0b\f\r", b"#*$%&|<>", bytes(range(0x80, 0xC0))


def text_counts(text: bytes) -> tuple[int, int, int]:
    """Characters in words, symbols, and lines with a word that repeat an earlier line, of a text in UTF-8."""
    dense = text.translate(None, _SPACES)
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(dense.translate(None, _FOLLOWING)), len(text) - len(text.translate(None, _SYMBOLS)), len(lines) - len(set(lines))


SCORES = "doc_id long, h1 long, h2 long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, bits double"
_SCORES = pa.schema([("doc_id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("lang", pa.string()), *[(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], ("bits", pa.float64())])


def _score(model: Model, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = Arrays(model)
        words: dict[str, dict[bytes, int]] = {}
        rows: list[tuple] = []
        held = 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal held
            bits = word_bits(arrays, model.order, {lang: list(listed) for lang, listed in words.items()})
            for at in range(0, len(rows), 1 << 14):
                part = [(*row[:-1], float(bits[row[3]][row[-1]].sum())) for row in rows[at : at + (1 << 14)]]
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), _SCORES, strict=True)], schema=_SCORES)
            words.clear()
            rows.clear()
            held = 0
            release()

        for batch in batches:
            for *key, lang, text in zip(*batch.columns, strict=True):
                lang, text = lang.as_py(), text.as_py()
                if lang not in words:
                    words[lang] = defaultdict(itertools.count().__next__)
                found = text.split()
                ids = np.fromiter(map(words[lang].__getitem__, found), np.int32, len(found))
                rows.append((*[k.as_py() for k in key], lang, len(found), *text_counts(text), repeated_words(ids.astype(np.int64)), ids))
                held += len(text) + 64
                if held >= block_bytes:
                    yield from close()
        yield from close()

    return run


def _hashes() -> list[Column]:
    text = plain_text("text")
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]


def score_documents(docs: DataFrame, model: Model, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Counts of whole texts and the bits of all their words under ``model``, as ``SCORES``; h1 and h2 are hashes of the text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_hashes(), plain_text("lang").alias("lang"), plain_text("text").cast("binary").alias("text"))
    return rows.mapInArrow(released(_score(model, block_bytes)), SCORES)


def bands(spark: SparkSession, scored: DataFrame) -> DataFrame:
    """``lang, center, within, between``: where the bits per word of a language's documents lie.

    ``center`` is their median. Their spread about it has two parts: ``between`` documents,
    and ``within / n_words``, the chance of the words themselves. Times ``n_words`` the square
    of a deviation is about ``within + between * n_words``, and its median over the shorter
    and over the longer half of the documents gives both. ``scored`` has lang, n_words, x.
    All medians are of rounded values, so that equal ones are counted together before they
    are shuffled.
    """
    rows = scored.select("lang", "n_words", F.round("x", 3).alias("x"), F.round(F.log2("n_words"), 2).alias("size"))

    def median(table: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
        counts = table.groupBy(*by, value).agg(F.count("*").alias("n"))
        return counts.groupBy(*by).agg(F.percentile(value, F.lit(0.5), F.col("n")).alias(name))

    middle = median(rows, ["lang"], "x", "center").join(median(rows, ["lang"], "size", "half"), "lang")
    middle = materialize(spark, middle, "lm-centers")
    rows = hot_join(spark, rows, middle, ["lang"], ["x", "n_words"], BROADCAST_LANGS)
    off = F.round(F.abs(F.col("x") - F.col("center")) * F.sqrt("n_words"), 2)
    rows = rows.select("lang", (F.col("size") <= F.col("half")).alias("short"), off.alias("off"), "size")
    spread = median(rows, ["lang", "short"], "off", "off").join(median(rows, ["lang", "short"], "size", "size"), ["lang", "short"])
    square, words = F.pow(F.lit(1.4826) * F.col("off"), F.lit(2.0)), F.pow(F.lit(2.0), F.col("size"))  # as of a normal distribution
    of = lambda short, c: F.max(F.when(F.col("short") == short, c))
    halves = spread.groupBy("lang").agg(of(True, square).alias("s"), of(True, words).alias("ns"), of(False, square).alias("l"), of(False, words).alias("nl"))
    between = F.greatest(F.coalesce(F.try_divide(F.col("l") - F.col("s"), F.col("nl") - F.col("ns")), F.lit(0.0)), F.lit(0.0))
    return middle.join(halves, "lang").select("lang", "center", F.greatest(F.col("s") - between * F.col("ns"), F.lit(0.0)).alias("within"), between.alias("between"))


def quality_rules(spark: SparkSession, docs: DataFrame, order: int = ORDER, band: float = BAND, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Counts of each text of ``docs`` and whether it passes: base rules, then its language's band of perplexity.

    Words are parted by the six ASCII white spaces, texts are whole, null is empty. Returns
    ``doc_id, lang, n_words, word_chars`` (code points in words), ``n_symbols`` (of
    ``#*$%&|<>``), ``n_dup_lines`` (lines with a word that equal an earlier line),
    ``n_repeat_words`` (words in windows of three that the text has twice or more),
    ``base_failed`` (under 50 words, or more than half of them such), ``log2_perplexity`` (bits
    per word; null without words), its band ``low`` and ``high``, ``kept``, and two hashes of
    the text. A band is the language's median plus and minus ``band`` spreads of documents
    of that length (see ``bands``), or at least ``band`` times ``LEAST_SPREAD``; it rests on
    all documents that pass the base rules. The model is counted over all documents.

    * Null and empty texts have no words and fail; a null language is one of its own, ''.
    * Equal texts of a language have equal results; a document at the edge of its band is
      kept; an empty table gives an empty result. Of other columns, whatever their names,
      nothing is read.
    """
    scored = materialize(spark, score_documents(docs, fit(spark, docs, order), block_bytes), "lm-scores")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    scored = scored.withColumns({"base_failed": failed, "x": F.try_divide("bits", "n_words")})
    where = materialize(spark, bands(spark, scored.where("not base_failed")), "lm-bands")
    found = hot_join(spark, scored, where, ["lang"], ["doc_id", "h1"], BROADCAST_LANGS)
    spread = F.greatest(F.sqrt(F.col("between") + F.coalesce(F.try_divide("within", "n_words"), F.lit(0.0))), F.lit(LEAST_SPREAD))
    # the center is rounded, so an edge is as wide as that
    off = F.lit(band) * spread + F.lit(0.001)
    found = found.withColumns({"low": F.col("center") - off, "high": F.col("center") + off})
    kept = ~F.col("base_failed") & F.coalesce(F.col("x").between(F.col("low"), F.col("high")), F.lit(True))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return found.select("doc_id", "lang", *counts, "base_failed", F.col("x").alias("log2_perplexity"), "low", "high", kept.alias("kept"), "h1", "h2")


def keep_fluent(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with the columns of ``docs``; equal texts of a language stay or go together."""
    lang, h1, h2 = (free_name(docs, n) for n in ("_lang", "_h1", "_h2"))
    gone = quality_rules(spark, docs, **options).where("not kept").select(F.col("lang").alias(lang), F.col("h1").alias(h1), F.col("h2").alias(h2)).distinct()
    a, b = _hashes()
    marked = docs.withColumns({lang: plain_text("lang"), h1: a, h2: b})
    return marked.join(gone, [lang, h1, h2], "left_anti").select(*docs.columns)


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    found = quality_rules(spark, docs)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log2_perplexity", "low", "high")
