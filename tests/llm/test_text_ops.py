"""Text operators: tokenizers, files, archives, licenses, quality, Jaccard, the pipeline."""

import base64
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import bpe, catalogue, common, license_texts, licenses, ngram_join, quality, token_files, vocabulary, warc
from tidemark.llm.common import shared_dir

from .test_small_ops import DOCS, HARD, _reach, clashing, hard  # noqa: F401

FOLDER = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def _ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_words_are_encoded_as_the_library_does(library):
    rng = random.Random(1)
    parts = list("aBcs'tré09²…’ \t\u0085 \x1c.,!?<|>ÉİΣςǅ中́ſKȺ") + ["'s", "'RE", "<|endoftext|>", "<|startoftext|>", "ﬁ", "🙂", "Å", "<|EndOfText|>", "''s"]
    for _ in range(4_000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        got = b"".join(vocabulary.encode_words(VOCABULARY, vocabulary.split_words(text))) if vocabulary.split_words(text) else b""
        assert np.frombuffer(got, "<u4").tolist() == _ids(library, text), repr(text)


def test_word_table_is_bounded():
    table = vocabulary.WordIds(VOCABULARY, most=3)
    assert [len(table[w]) for w in "a b c d e".split()] == [4] * 5
    assert len(table) <= 3


@pytest.mark.parametrize("block_chars", [bpe.BLOCK_CHARS, 500])
def test_bpe_round_trip(spark, library, block_chars):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = {r["doc_id"]: r for r in bpe.encode_documents(spark, docs, block_chars=block_chars).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(found) == set(texts)
    for i, text in texts.items():
        ids = _ids(library, text)
        assert np.frombuffer(found[i]["ids"], "<u4").tolist() == ids and found[i]["n_tokens"] == len(ids)
        assert found[i]["decoded"] == library.decode(ids, skip_special_tokens=False)


def test_bpe_hard_rows(spark, library, hard, clashing):  # noqa: F811
    for docs in (hard, clashing):
        found = Counter((r["doc_id"], bytes(r["ids"])) for r in bpe.encode_documents(spark, docs).collect())
        assert found == Counter((r[0], np.array(_ids(library, r[1]), "<u4").tobytes()) for r in HARD)
    assert bpe.encode_documents(spark, hard.limit(0)).count() == 0


def test_ids_from_anywhere_are_decoded(spark, library, hard, clashing):  # noqa: F811
    texts = ["Hello, world's 42", "", None, "a b " * 40_000, "<|endoftext|> x", "Hello, world's 42"]
    rows = [(i, None if t is None else np.array(_ids(library, t), "<u4").tobytes(), "x") for i, t in enumerate(texts)]
    for name in ("other", "decoded"):
        found = bpe.decode_documents(spark, spark.createDataFrame(rows, f"k long, ids binary, {name} string"))
        assert found.columns == ["k", "ids", name, "decoded" if name == "other" else "decoded_"]
        for r in found.collect():
            assert r[-1] == library.decode(_ids(library, texts[r["k"]]), skip_special_tokens=False)
    assert bpe.decode_documents(spark, spark.createDataFrame([], "k long, ids binary")).count() == 0


def test_bpe_parts_start_anew(spark, library):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in bpe.encode_documents(spark, docs, block_chars=3_000, known_words=50).collect():
        ids = _ids(library, texts[r["doc_id"]])
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["decoded"] == library.decode(ids, skip_special_tokens=False)


def test_variable_length_coding_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 1001):
        ids = (rng.integers(0, 2**26, n) >> rng.integers(0, 26, n)).astype("<u4")
        control, data = token_files.pack(ids)
        assert (token_files.unpack(np.frombuffer(control, "u1"), np.frombuffer(data, "u1"), n) == ids).all()
        content = token_files.dump([1, None], [n, 0], ids)
        docs, lengths, back = token_files.load(content)
        assert docs == [1, None] and lengths.tolist() == [n, 0] and (back == ids).all()
    for cut in (content[:-1], content[:50] + b"x" + content[51:]):
        with pytest.raises(ValueError):
            token_files.load(cut)


def test_token_files(spark, library):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    folder = shared_dir(spark, "test-tokens")
    manifest = token_files.write_token_files(spark, docs, folder, file_ids=5_000)
    assert manifest.count() > 5
    found = {r["doc_id"]: r for r in token_files.read_token_files(spark, manifest, folder).collect()}
    start = 0
    for r in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        ids = [*_ids(library, r["text"]), 1]
        got = found.pop(r["doc_id"])
        assert (got["start"], got["n_tokens"], bytes(got["ids"])) == (start, len(ids), np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert not found


def test_token_files_hard_rows(spark, hard, clashing):  # noqa: F811
    for docs in (hard, clashing):
        folder = shared_dir(spark, "test-tokens")
        manifest = token_files.write_token_files(spark, docs, folder)
        found = sorted(token_files.read_token_files(spark, manifest, folder).collect(), key=lambda r: r["start"])
        assert [r["doc_id"] for r in found] == [None, 1, 2, 3, 3, 5, 6]
        assert [r["start"] for r in found] == list(itertools.accumulate([0] + [r["n_tokens"] for r in found[:-1]]))
        assert [r["n_tokens"] for r in found if r["doc_id"] in (1, 2)] == [1, 1]
    folder = shared_dir(spark, "test-tokens")
    assert token_files.read_token_files(spark, token_files.write_token_files(spark, hard.limit(0), folder), folder).count() == 0


PAGES = [(1, "http://a/ b", "same"), (9, None, "same"), (4, "u", "same"), (5, "u", ""), (6, "u", None), (7, "u", "other é"), (7, "u", "other é"), (None, "u", "same"), (8, "u", "x" * 200_000)]


@pytest.mark.parametrize("groups, size", [(100_000, warc.ARCHIVE_BYTES), (0, 200)])
def test_warc_round_trip(spark, groups, size):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({n: F.lit(1) for n in ("hash", "salt", "first", "revisit")})
    folder = shared_dir(spark, "test-warc")
    written = warc.write_warc(spark, pages, folder, archive_bytes=size, broadcast_groups=groups)
    found = warc.read_warc(spark, written, folder).collect()
    last = {}
    for page, _, html in PAGES:
        last[html or ""] = max(page or -1, last.get(html or "", -1))
    wanted = Counter()
    for page, _, html in PAGES:
        body = (html or "").encode()
        first = last[html or ""]
        wanted[(page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if page == first else "revisit", None if page == first else first)] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found) == wanted
    assert {r["payload"] for r in found if r["page_id"] == 8} == {b"x" * 200_000}
    assert not [r for r in found if r["damage"]]
    empty = shared_dir(spark, "test-warc")
    assert warc.read_warc(spark, warc.write_warc(spark, pages.limit(0), empty), empty).count() == 0


def test_warc_threshold(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    folder = shared_dir(spark, "test-warc")
    found = warc.read_warc(spark, warc.write_warc(spark, pages, folder, revisit_bytes=5), folder).collect()
    assert {r["record_type"] for r in found if r["payload_bytes"] < 5} == {"response"}


@pytest.mark.parametrize("packed", [True, False])
def test_salvage(packed):
    rng = random.Random(2)
    records = [warc.record(i, f"http://x/{i}", bytes(rng.randrange(256) for _ in range(rng.randrange(300)))) for i in range(40)]
    parts = [warc.member(r) if packed else r for r in records]
    whole = b"".join(parts)
    assert [(f["headers"]["warc-record-id"], why) for _, _, f, why in warc.salvage(whole)] == [(f"<urn:page:{i}>", None) for i in range(40)]
    edges = list(itertools.accumulate(map(len, parts), initial=0))
    hurt = bytearray(whole)
    for i in (0, 7, 8, 39):
        # digests cover blocks, not headers
        hurt[edges[i] + len(parts[i]) // 2 if packed else edges[i + 1] - 10] ^= 0xFF
    hurt = bytes(hurt[: edges[20] + 10]) + b"noise WARC/1.1 noise" + bytes(hurt[edges[21] :])
    found = list(warc.salvage(hurt))
    read = [int(f["headers"]["warc-record-id"][10:-1]) for _, _, f, _ in found if f]
    assert read == [i for i in range(40) if i not in (0, 7, 8, 20, 39)]
    gaps = [(a, b) for a, b, f, _ in found if not f]
    assert gaps[0] == (0, edges[1]) and gaps[1] == (edges[7], edges[9])
    spans = [(a, b) for a, b, _, _ in found]
    assert spans[0][0] == 0 and spans[-1][1] == len(hurt) and all(x[1] == y[0] for x, y in itertools.pairwise(spans))


def _numbers(content):
    return [int(f["headers"]["warc-record-id"][10:-1]) for _, _, f, _ in warc.salvage(content) if f]


def test_salvage_looks_for_members_and_version_lines():
    zipped = warc.member(b"a body that its server packed")
    plain = [warc.record(i, f"http://x/{i}", zipped) for i in range(5)]
    damaged = b"XXXX" + b"".join(plain)[4:]
    assert _numbers(damaged) == [1, 2, 3, 4]
    assert [(a, b, why) for a, b, f, why in warc.salvage(damaged) if not f] == [(0, len(plain[0]), "no version line")]
    mixed = warc.member(plain[0]) + plain[1] + b"noise" + plain[2] + b"noise" + warc.member(plain[3]) + plain[4]
    assert _numbers(mixed) == [0, 1, 2, 3, 4]
    assert [b - a for a, b, f, _ in warc.salvage(mixed) if not f] == [5, 5]


def test_salvage_inside_members():
    rng = random.Random(3)
    plain = [warc.record(i, f"http://x/{i}", rng.randbytes(2_000)) for i in range(20)]
    whole = warc.member(b"".join(plain))
    assert list(warc.salvage(whole)) == [(0, len(whole), f, None) for _, _, f, _ in warc.salvage(b"".join(plain))] and _numbers(whole) == list(range(20))
    inner = [*plain[:3], plain[3].replace(b"WARC/1.1", b"XXXX/1.1"), *plain[4:]]
    assert _numbers(warc.member(b"".join(inner))) == [i for i in range(20) if i != 3]
    # cut, or with an unreadable place: what comes before is read, and so is what follows the member
    cut = whole[: len(whole) // 2]
    assert _numbers(cut) == list(range(len(_numbers(cut)))) and 8 <= len(_numbers(cut)) <= 10
    assert [why for _, _, f, why in warc.salvage(cut) if not f] == ["gzip member is cut short"]
    assert _numbers(cut + warc.member(warc.record(99, "u", b"x")))[-1] == 99
    # a broken member of one record is not trusted, as no digest covers its headers
    single = bytearray(warc.member(plain[0]))
    single[-6] ^= 0xFF
    assert _numbers(bytes(single)) == []


def _merged(found):
    """Neighbouring gaps with one reason as one."""
    out = []
    for start, end, record, why in found:
        if out and not record and not out[-1][2] and out[-1][1] == start and out[-1][3] == why:
            start = out.pop()[0]
        out.append((start, end, record, why))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_salvage_by_pieces_is_salvage(seed):
    rng = random.Random(seed)
    inner = warc.record(7, "inner", b"whole")
    plain = [warc.record(i, f"http://x/{i}", rng.randbytes(rng.randrange(3_000)) + (inner if i % 5 == 0 else b"")) for i in range(40)]
    parts = [warc.member(r) if rng.random() < 0.5 else r for r in plain] + [warc.member(b"".join(plain[:5])), rng.randbytes(5_000)]
    whole = bytearray(b"".join(parts))
    for _ in range(rng.randrange(6)):
        whole[rng.randrange(len(whole))] ^= 0xFF
    whole = bytes(whole)
    wanted = _merged(warc.salvage(whole))

    def read_at(at, n):
        return whole[at : at + min(n, rng.randrange(1, 700))]

    for window in (64, 1_000, 10_000_000):
        assert list(warc.salvage_stream(read_at, window)) == wanted
    # records longer than what may be held are the same, and gaps cover the same bytes
    for window, longest in ((64, 500), (1_000, 1_000)):
        found = list(warc.salvage_stream(read_at, window, longest))
        assert [(a, b, f) for a, b, f, _ in found if f] == [(a, b, f) for a, b, f, _ in wanted if f]
        assert _bytes(found) == _bytes(wanted)


def _bytes(found):
    return {i for a, b, f, _ in found if not f for i in range(a, b)}


@pytest.mark.parametrize("packed", [True, False])
def test_long_records_are_read_by_pieces(packed, monkeypatch):
    """One record far longer than what may be held, sound or damaged, between short ones; also many in one long member."""
    monkeypatch.setattr(warc, "PIECE", 1_000)
    rng = random.Random(4)
    body = rng.randbytes(300_000)
    plain = [warc.record(0, "u", b"a"), warc.record(99, "long", body), warc.record(1, "v", b"b")]
    parts = [warc.member(r) if packed else r for r in plain]
    longest = 0

    def found(content, payloads=True):
        nonlocal longest
        longest = 0

        def read_at(at, n):
            nonlocal longest
            longest = max(longest, n)
            return content[at : at + n]

        return list(warc.salvage_stream(read_at, 2_000, 8_000, payloads))

    whole = b"".join(parts)
    records = found(whole)
    assert [(f["headers"]["warc-record-id"], f["size"]) for _, _, f, _ in records] == [("<urn:page:0>", 1), ("<urn:page:99>", 300_000), ("<urn:page:1>", 1)]
    assert records[1][2]["payload"] == body and records[1][2]["digest"] == warc.digest32(body) and longest <= 8_000
    assert [(a, b) for a, b, _, _ in records] == list(itertools.pairwise(itertools.accumulate(map(len, parts), initial=0)))
    assert found(whole, False)[1][2]["payload"] is None
    hurt = bytearray(whole)
    hurt[len(parts[0]) + len(parts[1]) - 200] ^= 0xFF
    ids = [int(f["headers"]["warc-record-id"][10:-1]) for _, _, f, _ in found(bytes(hurt)) if f]
    assert ids == [0, 1]
    gaps = [(a, b) for a, b, f, _ in found(bytes(hurt)) if not f]
    assert gaps[0][0] == len(parts[0]) and gaps[-1][1] == len(parts[0]) + len(parts[1])
    cut = whole[: len(parts[0]) + 100_000]
    assert [int(f["headers"]["warc-record-id"][10:-1]) for _, _, f, _ in found(cut) if f] == [0] and found(cut)[-1][1] == len(cut)
    many = warc.member(b"".join(warc.record(i, "u", rng.randbytes(500)) for i in range(100)))
    assert [int(f["headers"]["warc-record-id"][10:-1]) for _, _, f, _ in found(many + plain[0])] == [*range(100), 0]


@pytest.mark.parametrize("packed", [True, False])
def test_damaged_archives_through_spark(spark, packed):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"<p>page {i} " + "text " * (i * 7)) for i in range(60)], "page_id long, url string, html string")
    folder = shared_dir(spark, "test-warc")
    written = warc.write_warc(spark, pages, folder, archive_bytes=4_000)
    lost, paths = set(), sorted(r["path"] for r in written.collect())
    assert len(paths) > 3
    for n, path in enumerate(paths):
        content = open(path, "rb").read()
        spans = [(a, b, int(f["headers"]["warc-record-id"][10:-1])) for a, b, f, _ in warc.salvage(content)]
        if not packed:
            parts = [warc.record(i, f"http://x/{i}", f"<p>page {i} ".encode() + b"text " * (i * 7)) for _, _, i in spans]
            content, ends = b"".join(parts), list(itertools.accumulate(map(len, parts)))
            spans = [(b - len(p), b, i) for b, p, (_, _, i) in zip(ends, parts, spans, strict=True)]
        if n % 2 == 0:
            a, b, i = spans[len(spans) // 2]
            lost.add(i)
            content = content[:a] + b"noise" + content[a + 5 : b - 6] + b"\x00" * 6 + content[b:]
        with open(path, "wb") as f:
            f.write(content)
    records = warc.read_warc(spark, written, folder)
    found = {r["page_id"]: r["payload"] for r in records.collect() if r["damage"] is None}
    assert set(found) == set(range(60)) - lost and lost
    assert all(body == f"<p>page {i} ".encode() + b"text " * (i * 7) for i, body in found.items())
    gaps = warc.log_quarantine(records, shared_dir(spark, "test-quarantine")).collect()
    assert {g["path"] for g in gaps} == {p for n, p in enumerate(paths) if n % 2 == 0} and all(g["n_bytes"] == g["end"] - g["start"] > 0 and g["damage"] for g in gaps)


@pytest.mark.parametrize("name", ["op1_embedding_near_dedup", "op4_license_scan", "op7_warc", "op9_maxscore_topk", "op10_ngram_jaccard"])
def test_queries_and_their_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    wanted = con.execute(catalogue.ORACLE_SQL[name])
    columns = [c[0] for c in wanted.description]
    found = catalogue.QUERIES[name](spark, FOLDER)
    assert sorted(found.columns) == sorted(columns)
    assert Counter(map(tuple, found.select(*columns).collect())) == Counter(wanted.fetchall())


def test_licenses_against_brute_force(spark, hard, clashing):  # noqa: F811
    rng = random.Random(4)
    pool = ["cc", "BY", "by", "general", "Public", "license,", "all rights", "reserved", "CC-by", "x", "é", "K", "general_public license", "licensed under the apache license", "version 2 0"]
    rows = [(i, " ".join(rng.choices(pool, k=rng.randint(0, 30))), "en", "s", 0) for i in range(300)]
    found = {r["doc_id"]: r for r in licenses.scan_licenses(spark, spark.createDataFrame(rows, DOCS)).collect()}
    for i, text, *_ in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
        words = re.findall(licenses.WORD, low)
        places = [(s, label) for p, label in licenses.BASE for s in range(len(words)) if words[s : s + len(p.split())] == p.split()]
        r = found[i]
        starts = [s for s, _ in places]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(places), min(starts, default=None), max(starts, default=None))
        labels = sorted({label for _, label in places})
        assert r["base_labels"] == ",".join(labels) and set(labels) <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])
    for docs in (hard, clashing):
        assert licenses.scan_licenses(spark, docs).count() == len(HARD)
    assert licenses.scan_licenses(spark, hard.limit(0)).count() == 0


def test_license_spans_survive_small_edits(spark):
    text = "x y Permission is hereby granted, free of charge, to ANY person who is obtaining a copy of this software z"
    rows = [(1, text, "en", "s", 0), (1, text, "en", "s", 0), (None, text, "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    assert {(r["label"], r["start"], r["stop"]) for r in licenses.license_spans(spark, docs).collect()} == {("mit", 2, 20)}
    assert [r["labels"] for r in licenses.scan_licenses(spark, docs).collect()] == ["mit"] * 3


def test_near_miss_licenses(spark):
    cc, gpl, mit = "Licensed under the Creative Commons Attribution {} License", "This work is licensed under the GNU {}General Public License{}", "Permission is hereby granted, free of charge, to any person {}"
    cases = {
        cc.format("4.0 International"): "cc-by-4.0",
        cc.format("NonCommercial 4.0 International"): "",
        cc.format("Non-Commercial 4.0 International"): "",
        cc.format("ShareAlike 4.0 International"): "",
        cc.format("NonCommercial NoDerivatives 4.0 International"): "",
        cc.format("3.0 International"): "",
        "Licensed under CC BY-NC 4.0": "cc-by,cc-by-nc-4.0",
        "Licensed under CC BY-NC-SA 4.0": "cc-by",
        gpl.format("", ", version 3"): "gpl,gpl-3.0",
        gpl.format("", " version 3, 29 June 2007"): "gpl,gpl-3.0",
        gpl.format("", " v3"): "gpl,gpl-3.0",
        gpl.format("", ", version 2"): "gpl",
        gpl.format("", ""): "gpl",
        gpl.format("Affero ", ", version 3"): "gpl",
        "GNU General Public License as published by the Free Software Foundation": "gpl",
        "GNU Lesser General Public License as published by the Free Software Foundation": "gpl,lgpl",
        "Licensed under the Apache License, Version 2.0, 2020 x": "apache-2.0",
        "Licensed under the Apache License, Version 2": "apache-2.0",
        "Licensed under the Apache License, Version 2.1": "",
        "Licensed under the Apache License, Version 1.1": "",
        "Licensed under the Eclipse Public License, Version 2.0": "",
        "Released under the MIT licence.": "mit",
        "Released under the MIT No Attribution License.": "",
        mit.format("who is obtaining a copy of this software"): "mit",
        mit.format("or organization obtaining a copy of the software"): "",
        "This is not released under the MIT license": "",
        "It was never, ever licensed under the Apache License, Version 2.0": "",
        "Not so: it is released under the MIT license": "mit",
        "license MIT the under released": "",
    }
    rows = [(2 * i + k, f"{start}{text}{end}", "en", "s", 0) for i, text in enumerate(cases) for k, (start, end) in enumerate((("x y ", ""), ("", " z and so on")))]
    docs = spark.createDataFrame(rows, DOCS)
    found = licenses.scan_licenses(spark, docs).collect()
    for r in found:
        text, wanted = list(cases.items())[r["doc_id"] // 2]
        assert r["labels"] == wanted and (r["score"] > 0) == bool(wanted), (text, r)
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    assert sorted(map(tuple, found)) == sorted(con.execute(licenses.OP4_SQL).fetchall())


def test_whole_licenses(spark):
    rng = random.Random(13)
    by_label = {label: text.split() for label, text, _, _ in license_texts.BODIES}
    same = {"bsl-1.0": "bsl-1.0,mit", "gpl-3.0": "gpl,gpl-3.0", "gpl-2.0": "gpl,gpl-2.0", "lgpl-3.0": "gpl,lgpl,lgpl-3.0", "lgpl-2.1": "gpl,lgpl,lgpl-2.1", "agpl-3.0": "agpl-3.0,gpl", "bsd-2-clause": "bsd,bsd-2-clause", "bsd-3-clause": "bsd,bsd-3-clause"}
    rows, wanted = [], []
    for label, words in by_label.items():
        edited = list(words)
        for _ in range(len(words) // 40):  # names of holders and the like, put in or for other words
            at = rng.randrange(len(words) // 3, len(edited))
            if edited[at] in ("lesser", "affero", "version", "sublicense", "endorse", "or", "promote", "fee", "misrepresented"):
                continue
            edited[at : at + rng.choice([0, 1])] = ["jane", "doe"]
        for text in (words, [w.upper() + "," for w in words], ["x"] * 50 + edited + ["y"] * 50):
            rows.append((len(rows), " ".join(text), "en", "s", 0))
            wanted.append(label)
    # the words of a license in another order are no license
    shuffled = sorted(by_label["mit"], key=lambda w: rng.random())
    pieces = [by_label["isc"][i : i + 9] for i in range(0, 90, 9)]
    rows += [(len(rows), " ".join(shuffled), "en", "s", 0), (len(rows) + 1, " ".join(sum(reversed(pieces), [])), "en", "s", 0)]
    found = {r["doc_id"]: r for r in licenses.scan_licenses(spark, spark.createDataFrame(rows, DOCS)).collect()}
    for i, label in enumerate(wanted):
        got = set(found[i]["labels"].split(","))
        assert label in got and got <= set(same.get(label, label).split(",")) | {"mit", "bsd", "lgpl", "unlicense"}, (label, found[i])
        assert not {"gpl-2.0", "gpl-3.0", "lgpl-3.0", "lgpl-2.1", "agpl-3.0", "bsd-2-clause", "bsd-3-clause"} & got - {label}, (label, found[i])
    assert "mit" not in found[len(wanted)]["labels"] and "isc" not in found[len(wanted) + 1]["labels"]


def test_license_hard_rows(spark, hard, clashing):  # noqa: F811
    for docs in (hard, clashing):
        found = sorted(((r["doc_id"] or 0, r["n_words"], r["n_base"], r["first_word"], r["base_labels"], r["labels"], r["score"]) for r in licenses.scan_licenses(spark, docs).collect()), key=str)
        words = {0: 1, 1: 0, 2: 0, 3: 3, 5: 50_000, 6: 3}
        assert found == sorted(((k, words[k], 0, None, "", "", 0.0) for k in (0, 1, 2, 3, 3, 5, 6)), key=str)
    line = "CC-BY all RIGHTS reserved " * 3
    rows = [(1, line, "en", "s", 0), (1, line, "en", "s", 0), (None, line, "en", "s", 0), (2, "x " * 300_000 + line, "en", "s", 0)]
    for r in licenses.scan_licenses(spark, spark.createDataFrame(rows, DOCS)).collect():
        first = 300_000 if r["doc_id"] == 2 else 0
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["labels"]) == (first + 15, 6, first, first + 12, "cc-by,reserved")


def _labelled(rng, n):
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        text = " ".join(rng.choices(words, k=rng.randint(30, 120)))
        docs.append((i, text if good else re.sub(" ", "$$$ ", text.upper()), "en", "s", len(text)))
        labels.append((i, int(good), 0))
    return docs, labels


def _brute_score(model, text):
    """The score from the model's parts alone."""
    import zstandard

    content = (text or "").encode()
    sizes = []
    for held in (model.good, model.bad):
        packer = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(held), write_content_size=False, write_checksum=False, write_dict_id=False)
        sizes.append(sum(len(packer.compress(content[i : i + quality.BLOCK])) for i in range(0, len(content), quality.BLOCK)))
    a, b, c = model.weights
    return 1 / (1 + np.exp(-(a + b * (sizes[1] - sizes[0]) / max(1, len(content)) + c / np.sqrt(len(content) + 1))))


def test_quality_of_the_given_tables(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(spark, docs, labels)
    scored = docs.select("doc_id", "text", quality.score_column(model, F.col("text")).alias("score"), quality.held_out(F.col("doc_id")).alias("held"))
    marks = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = scored.collect()
    for r in rows[::97]:
        assert r["score"] == pytest.approx(_brute_score(model, r["text"]), abs=1e-9)
    held = [(marks[r["doc_id"]], r["score"]) for r in rows if r["held"] and marks.get(r["doc_id"]) is not None]
    y, p = np.array([h[0] for h in held]), np.array([h[1] for h in held])
    above = (p[y == 1][:, None] > p[y == 0][None, :]).mean() + (p[y == 1][:, None] == p[y == 0][None, :]).mean() / 2
    assert len(held) > 1_000 and above > 0.995 and ((p - y) ** 2).mean() < 0.01 and ((p >= 0.5) == y).mean() > 0.99


def test_quality_sample_is_bounded_by_rows_and_bytes(spark):
    docs, labels = _labelled(random.Random(9), 300)
    d, y = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    whole, few, short = (quality.fit(spark, d, y, **o) for o in ({}, {"sample_rows": 20}, {"sample_bytes": 4_000}))
    assert len({whole.name, few.name, short.name}) == 3
    assert len(short.good) <= 4_000
    # a long text is one sample, all of it
    assert b"tail words of the text" in quality.dictionary([b"x y z " * 1_000 + b"tail words of the text"])


def test_one_long_text_does_not_empty_a_class(spark):
    docs, labels = _labelled(random.Random(9), 600)
    first = {}
    for y in (0, 1):
        keys = spark.createDataFrame([(i,) for i, q, _ in labels if q == y], "k long").where(~quality.held_out(F.col("k")))
        first[y] = keys.orderBy(F.xxhash64("k"), "k").first()["k"]
    longer = [(i, t * 200 if i in first.values() else t, *r) for i, t, *r in docs]
    y = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    scores = []
    for rows in (docs, longer, [(i, t * 300, *r) for i, t, *r in docs[:120]]):
        d = spark.createDataFrame(rows, DOCS)
        found = quality.score_documents(spark, d, y, sample_bytes=60_000).where(quality.held_out(F.col("doc_id"))).collect()
        scores.append({r["doc_id"]: r["score"] for r in found})
        truth = {i: q for i, q, _ in labels}
        right = sum((s >= 0.5) == truth[i] for i, s in scores[-1].items())
        assert len(set(scores[-1].values())) > 0.8 * len(scores[-1]) / (1 if rows is not docs[:120] else 2)
        assert right >= 0.9 * len(scores[-1])


def test_kept_rows_of_hard_tables(spark, hard, clashing):  # noqa: F811
    docs, labels = _labelled(random.Random(7), 300)
    y = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    train = spark.createDataFrame(docs, DOCS)
    for table in (hard, clashing, hard.withColumn("score", F.lit("x")).withColumn("Predicted", F.lit(1)), hard.limit(0)):
        both = table.unionByName(train.select(*[F.col(c) if c in train.columns else F.lit(None).cast(t).alias(c) for c, t in table.dtypes]))
        kept = quality.keep_good(spark, both, y)
        assert kept.columns == both.columns
        good = {r["doc_id"] for r in quality.score_documents(spark, both.select("doc_id", "text"), y).where("predicted = 1").collect()}
        assert {r["doc_id"] for r in kept.collect()} == good
    nothing = quality.keep_good(spark, hard, y.limit(0))
    assert nothing.count() == len(HARD)  # without labels nothing is rejected
    assert quality.keep_good(spark, hard.limit(0), y).count() == 0


def test_quality_on_held_out_rows(spark):
    docs, labels = _labelled(random.Random(6), 900)
    d, y = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = quality.score_documents(spark, d, y).withColumn("held_out", quality.held_out(F.col("doc_id"))).collect()
    assert len(found) == 900
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [r for r in found if r["held_out"]]
    assert sum(r["predicted"] == labels[r["doc_id"]][1] for r in held) / len(held) > 0.97
    flipped = spark.createDataFrame([(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q, t) for i, q, t in labels], "doc_id long, quality int, toxic int")
    again = quality.score_documents(spark, d, flipped).collect()
    assert {r["doc_id"]: r["score"] for r in again} == {r["doc_id"]: r["score"] for r in found}
    kept = quality.keep_good(spark, d, y)
    assert kept.columns == d.columns and kept.count() == sum(r["predicted"] for r in found)


def test_quality_hard_rows(spark, hard, clashing):  # noqa: F811
    docs, labels = _labelled(random.Random(7), 400)
    y = spark.createDataFrame([*labels, (5, None, 1), (None, 1, 0), (3, 0, 0), (3, 1, 0), (7, 9, 0)], "doc_id long, quality int, toxic int")
    for d in (hard, clashing):
        d = d.unionByName(spark.createDataFrame(docs, DOCS), allowMissingColumns=True)
        found = quality.score_documents(spark, d, y)
        assert found.columns[: len(d.columns)] == d.columns and len({c.lower() for c in found.columns}) == len(found.columns)
        assert found.where(f"{found.columns[-2]} between 0 and 1").count() == d.count()
    none = y.limit(0)
    assert {r["score"] for r in quality.score_documents(spark, hard, none).collect()} == {0.5}
    assert quality.score_documents(spark, hard.limit(0), y).count() == 0


def _grams(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


@pytest.mark.parametrize("options", [{}, {"batch_grams": 300, "block_rows": 4, "block_grams": 500, "broadcast_rows": 0}])
def test_jaccard_against_brute_force(spark, monkeypatch, options):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    base = [[rng.choice(words) for _ in range(rng.choice([3, 12, 60, 90]))] for _ in range(25)]
    passage = [f"p{i}" for i in range(50)]
    rows = []
    for i in range(330):
        text = list(base[min(int(rng.expovariate(0.15)), 24)])
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            text[rng.randrange(len(text))] = rng.choice(words)
        if i % 5 == 0:
            text = text[:20] + passage
        rows.append((i, " ".join(text).upper() if i % 3 else "\t".join(text), "en", "s", 0))
    rows += [(400, None, "en", "s", 0), (401, "", "en", "s", 0), (402, " \n ", "en", "s", 0)]
    sets = {r[0]: _grams(r[1]) for r in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    label = _reach(sets, links)
    if options:
        monkeypatch.setattr(ngram_join, "CAP", 4)
        monkeypatch.setattr(ngram_join, "FEW_ROWS", 3)
    found = ngram_join.jaccard_components(spark, spark.createDataFrame(rows, DOCS), **options).collect()
    assert len(found) == len(rows) and len(links) > 300
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == {i: (len(s), label[i]) for i, s in sets.items()}


def _broadcasts(spark, since=0):
    """Plans that broadcast a table, of those that ran as number ``since`` and later; how many there are now."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    ran = spark._jsparkSession.sharedState().statusStore().executionsList()
    plans = {e.executionId(): e.physicalPlanDescription() for e in (ran.apply(i) for i in range(ran.size()))}
    return [p for i, p in plans.items() if i >= since and "BroadcastExchange" in p], max(plans, default=-1) + 1


def test_salted_copies_are_not_broadcast(spark):
    rows = spark.range(300).selectExpr("id", "id % 60 AS k")
    table = common.materialize(spark, spark.range(50).selectExpr("id AS k", "1 AS part"), "test-table")
    _, since = _broadcasts(spark)
    found = common.hot_join(spark, rows, table, ["k"], ["id"], broadcast_rows=40).collect()
    assert not _broadcasts(spark, since)[0]
    assert sorted(map(tuple, found)) == [(k, i, 1 if k < 50 else None) for k, i in sorted((i % 60, i) for i in range(300))]


def test_jaccard_broadcasts_nothing_large(spark):
    rng = random.Random(12)
    base = [[f"w{rng.randrange(80)}" for _ in range(40)] for _ in range(12)]
    rows = []
    for i in range(120):
        text = list(rng.choice(base))
        text[rng.randrange(40)] = f"w{rng.randrange(80)}"
        rows.append((i, " ".join(text), "en", "s", 0))
    docs = spark.createDataFrame(rows, DOCS)
    _, since = _broadcasts(spark)
    options = {"batch_grams": 300, "block_rows": 4, "block_grams": 500, "broadcast_rows": -1}  # even empty tables count as large
    kept = ngram_join.keep_one(spark, docs, broadcast_ids=-1, **options).collect()
    assert not _broadcasts(spark, since)[0]
    whole = ngram_join.keep_one(spark, docs).collect()
    assert _broadcasts(spark, since)[0] and sorted(kept) == sorted(whole) and 0 < len(kept) < 120


def test_jaccard_hard_rows(spark, hard, clashing):  # noqa: F811
    for docs in (hard, clashing):
        found = sorted(((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(spark, docs).collect()), key=str)
        assert found == sorted([(0, 1, None), (1, 0, 1), (2, 0, 2), (3, 1, 3), (3, 1, 3), (5, 1, 5), (6, 1, 3)], key=str)
        kept = ngram_join.keep_one(spark, docs)
        assert kept.columns == docs.columns
        assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 5]
    assert ngram_join.jaccard_components(spark, hard.limit(0)).count() == 0
    assert ngram_join.keep_one(spark, hard.limit(0)).count() == 0


def test_overlaps_is_the_product():
    rng = np.random.default_rng(9)
    rows = [np.unique(rng.integers(0, 80, rng.integers(0, 60))).astype("<u8") for _ in range(23)]
    left, right = rows[:15], rows[10:]
    wanted = np.array([[len(np.intersect1d(a, b)) for b in right] for a in left])
    assert (ngram_join.overlaps(left, right, np.zeros(wanted.shape, int)) == wanted).all()


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = docs.columns
    held = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = shared_dir(spark, "test-stage")
        stage(spark, docs, FOLDER).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == names, name
        held.append(docs.count())
    assert 0 < held[2] < held[1] < held[0]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    library = Tokenizer.from_file(VOCABULARY)
    texts = {r["doc_id"]: r["text"] for r in pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()}
    assert len(last) == held[3]
    for r in last:
        ids = np.array(_ids(library, texts[r["doc_id"]]), "<u4")
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
    run = corpus_pipeline.run(spark, FOLDER).select("doc_id", "ids_sha256").collect()
    assert Counter(map(tuple, run)) == Counter((r["doc_id"], r["ids_sha256"]) for r in last)


def test_long_text_is_whole(spark):
    text = " ".join(f"w{i}" for i in range(400_000))
    docs = spark.createDataFrame([(1, text, "en", "s", 0), (2, text + " end", "en", "s", 0)], DOCS)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(spark, docs).collect()}
    assert found == {1: (399_996, 1), 2: (399_997, 1)}
