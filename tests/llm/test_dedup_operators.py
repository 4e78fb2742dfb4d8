"""Operators that compare texts, and the pipeline, against brute force on small tables."""

from __future__ import annotations

import hashlib
import os
import random
import tracemalloc
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash

import corpus_pipeline
from pyspark.sql import functions as F

from sqltrail.llm import components, exact_dedup, simhash, suffix_dedup
from sqltrail.llm.queries import ORACLE_SQL, QUERIES

SF_DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, _key string, spans string, place int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", None, "a", "b", "c", 1) for i, t in rows], DOCS)


def words(rng, n, stock=500):
    return " ".join(f"w{rng.randrange(stock)}" for _ in range(n))


# --- exact dedup ---


def test_exact_groups(spark):
    long = "x" * 1000
    rows = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b"), (6, long + "1"), (7, long + "2"), (8, long + "2"), (9, "A"), (None, "a"), (5, "b"), (None, "z")]
    found = exact_dedup.exact_groups(frame(spark, rows), digest=True).collect()
    groups: dict = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    wanted = Counter()
    for i, t in rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        wanted[i, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in found) == wanted
    assert exact_dedup.exact_groups(frame(spark, [])).count() == 0


def test_exact_groups_with_one_slot(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SLOTS", 1)
    rows = [(i, f"text {i % 7}") for i in range(50)]
    found = exact_dedup.exact_groups(frame(spark, rows)).collect()
    assert {(r["doc_id"], r["keep_id"]) for r in found} == {(i, max(j for j in range(50) if j % 7 == i % 7)) for i in range(50)}


# --- SimHash ---


def simhash_by_hand(text: str | None) -> int:
    tokens = (text or "").encode().lower().split()
    shingles = [b" ".join(tokens[i : i + 3]) for i in range(max(1, len(tokens) - 2))] if tokens else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def components_by_hand(prints: list[int], ids: list[int]) -> list[int]:
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least: dict = {}
    for k, i in enumerate(ids):
        least[find(k)] = min(i, least.get(find(k), i))
    return [least[find(k)] for k in range(len(ids))]


def near_copies(seed=4):
    rng = random.Random(seed)
    texts = [None, "", " \n", "One", "one", "one two", "ONE two", "é é é é"]
    for _ in range(12):
        base = words(rng, 150).split()
        for _ in range(12):
            copy = list(base)
            copy[rng.randrange(150)] = "new"
            texts.append(" ".join(copy))
    return [(10 * i + 3, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("paired", [1, 24])
def test_simhash_against_brute_force(spark, monkeypatch, paired):
    rows = near_copies()
    prints = [simhash_by_hand(t) for _, t in rows]
    wanted = components_by_hand(prints, [i for i, _ in rows])
    if paired == 1:
        plain = simhash.links
        monkeypatch.setattr(simhash, "links", lambda nodes: plain(nodes, paired=1))
    found = {r["doc_id"]: (r["fp"] % 2**64, r["component_id"]) for r in simhash.simhash_groups(frame(spark, rows)).collect()}
    assert found == {i: (p, w) for (i, _), p, w in zip(rows, prints, wanted)}
    assert len(set(wanted)) < len(set(prints))


def test_simhash_odd_rows(spark):
    found = simhash.simhash_groups(frame(spark, [(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (9, None), (None, "x y z")])).collect()
    assert len(found) == 5 and {r["component_id"] for r in found if r["fp"] == found[0]["fp"]} <= {5, 9, None}
    assert simhash.simhash_groups(frame(spark, [])).count() == 0


def test_links_of_random_fingerprints(spark):
    rng = random.Random(8)
    prints = {rng.getrandbits(64) for _ in range(20)}
    for p in list(prints):
        prints |= {p ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(10)}
    signed = [(p - 2**64 if p >= 2**63 else p,) for p in prints]
    nodes = spark.createDataFrame(signed, "fp long")
    found = components.components(simhash.links(nodes)).collect()
    root = {r["node"]: r["root"] for r in found} | {r["root"]: r["root"] for r in found}
    listed = [s[0] for s in signed]
    wanted = components_by_hand([s % 2**64 for s in listed], listed)
    groups = lambda keys: {frozenset(x for x, k in zip(listed, keys) if k == key) for key in keys}
    assert groups([root.get(s, s) for s in listed]) == groups(wanted)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 300)] + [(1000, 1001), (1001, 1000), (7, 7)], "a long, b long")
    found = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert found == {i: 0 for i in range(1, 301)} | {1001: 1000}
    assert components.components(edges.where("false")).count() == 0


# --- suffix-array dedup ---


def removal_by_hand(rows, window=200):
    texts = [(t or "").encode() for _, t in rows]
    counts = Counter(t[j : j + window] for t in texts for j in range(len(t) - window + 1))
    out = Counter()
    for (i, _), text in zip(rows, texts):
        covered = np.zeros(len(text), bool)
        for j in range(len(text) - window + 1):
            if counts[text[j : j + window]] > 1:
                covered[j : j + window] = True
        runs = int((np.diff(np.concatenate([[0], covered.astype(int)])) == 1).sum())
        kept = np.frombuffer(text, np.uint8)[~covered].tobytes()
        out[i, len(text), int(covered.sum()), runs, hashlib.sha256(kept).hexdigest()] += 1
    return out


def repeated_rows(seed=6):
    rng = random.Random(seed)
    rows = [(1, None), (2, ""), (3, "short"), (4, "z" * 199), (5, "z" * 200), (6, "q" * 700), (None, words(rng, 100)), (7, "é" * 150)]
    passages = [words(rng, 60) for _ in range(4)]
    for i in range(10, 70):
        text = words(rng, rng.randint(10, 200))
        for _ in range(rng.randrange(3)):
            p, at = rng.choice(passages), rng.randrange(len(text))
            cut = rng.randrange(100)
            text = text[:at] + p[cut : rng.randint(cut + 150, len(p))] + text[at:]
        rows.append((i, text))
    base = words(rng, 200)
    for i in range(100, 130):
        at = rng.randrange(len(base))
        rows.append((i, base[:at] + rng.choice(["", "#", "changed here"]) + base[at + rng.randrange(5) :]))
    copied = words(rng, 80)
    return rows + [(200, copied), (201, copied), (201, copied), (202, copied[:250]), (202, copied[5:260])]


@pytest.mark.parametrize("group_rows", [32_000, 0])
def test_removal_against_brute_force(spark, monkeypatch, group_rows):
    monkeypatch.setattr(suffix_dedup, "GROUP_ROWS", group_rows)
    rows = repeated_rows()
    found = suffix_dedup.removal_digests(frame(spark, rows)).collect()
    assert Counter(tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in found) == removal_by_hand(rows)


def test_removal_of_nothing(spark):
    assert suffix_dedup.removal_digests(frame(spark, [])).count() == 0
    found = suffix_dedup.removal_digests(frame(spark, [(1, "a"), (2, None)])).collect()
    assert [r["n_removed"] for r in found] == [0, 0]


def test_cut_repeats_keeps_rows_columns_and_characters(spark):
    rows = [(1, "ü" * 120 + "é"), (2, "ü" * 120 + "è"), (3, None), (4, "plain")]
    found = suffix_dedup.cut_repeats(frame(spark, rows))
    assert found.columns == frame(spark, rows).columns
    got = {r["doc_id"]: r["text"] for r in found.collect()}
    assert got == {1: "é", 2: "è", 3: None, 4: "plain"}


def test_places_are_the_same_in_equal_windows():
    rng = random.Random(2)
    one, two = words(rng, 2000).encode(), words(rng, 50).encode()
    shared = words(rng, 100).encode()
    texts = [one[:3000] + shared + one[3000:], two + shared]
    places = {i: set(at.tolist()) for i, at, _ in suffix_dedup.sampled_places(texts)}
    for j in range(len(shared) - 199):
        first = {p - 3000 - j for p in places[0] if 0 <= p - 3000 - j <= 200 - suffix_dedup.LEAD}
        second = {p - len(two) - j for p in places[1] if 0 <= p - len(two) - j <= 200 - suffix_dedup.LEAD}
        assert first & second


def test_a_sorted_context_takes_little_memory(monkeypatch):
    class Task:
        partitionId = staticmethod(lambda: 0)  # noqa: N815
        get = classmethod(lambda cls: cls)

    monkeypatch.setattr(suffix_dedup, "TaskContext", Task)
    rng, n = np.random.default_rng(1), 5000
    texts = lambda size: pa.array([rng.integers(0, 256, size, np.uint8).tobytes() for _ in range(n)])
    columns = [pa.array(range(n)), pa.array(range(n)), pa.array([False] * n), texts(suffix_dedup.WINDOW), texts(suffix_dedup.LEFT)]
    batch = pa.RecordBatch.from_arrays(columns, ["doc", "place", "dup", "right", "left"])
    tracemalloc.start()
    found = list(suffix_dedup._sort_suffixes(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(b.num_rows for b in found) == 2 and peak < 1400 * n


def test_contexts_of_any_length_and_chunk():
    rows = [b"abc", b"", b"x" * 8, b"\0\0", b"yy"] * 2000
    chunks = pa.chunked_array([pa.array(rows[:7]), pa.array([], pa.binary()), pa.array([b"no", *rows[7:]]).slice(1)])
    matrix, sizes = suffix_dedup._matrix(chunks, 8)
    assert sizes.tolist() == [len(r) for r in rows]
    assert [r.tobytes() for r in matrix] == [r.ljust(8, b"\0") for r in rows]


def test_multikey_quicksort():
    rows = np.random.default_rng(3).integers(0, 3, (5000, 6)).astype(np.uint64)
    order = suffix_dedup.multikey_quicksort(rows)
    assert [tuple(r) for r in rows[order]] == sorted(map(tuple, rows))


# --- queries and pipeline ---


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not there")
def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_DIR}/documents.parquet'")
    for name, sql in ORACLE_SQL.items():
        cursor = con.execute(sql)
        columns = [d[0] for d in cursor.description]
        found = QUERIES[name](spark, SF_DIR).select(*columns).collect()
        assert Counter(map(tuple, found)) == Counter(cursor.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not there")
def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = corpus_pipeline.stored(stage(spark, docs, SF_DIR))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert after.keys() <= before.keys() and len(after) > 0.5 * len(before)
        if name == "exact_dedup":
            keep = {}
            for i, t in before.items():
                keep[t or ""] = max(i, keep.get(t or "", i))
            assert set(after) == set(keep.values())
        if name == "simhash_near_dedup":
            ids = sorted(before)
            wanted = components_by_hand([simhash_by_hand(before[i]) for i in ids], ids)
            assert set(after) == {i for i, c in zip(ids, wanted) if i == c}
        if name == "suffix_array_dedup":
            removed = {k[0]: k[2] for k in removal_by_hand(sorted(before.items()))}
            for i, t in after.items():
                cut = len((before[i] or "").encode()) - len((t or "").encode())
                assert removed[i] - 6 * max(1, removed[i] // 200) <= cut <= removed[i]
        if name != "suffix_array_dedup":
            assert all(after[i] == before[i] for i in after)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).collect()
    got = Counter()
    for r in packed:
        got[r["doc_id"]] += r["length"]
    assert got == {i: len((t or "").encode().split()) + 1 for i, t in after.items()}


def test_pipeline_judges_rows_and_not_ids(spark, tmp_path):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(400):
        toxic = i % 2
        docs.append((i, words(rng, 40) + (" filthy scumbag vermin idiots" * 6 if toxic else "")))
        labels.append((i, toxic))
    clean, bad = words(rng, 60), words(rng, 40) + " filthy scumbag vermin idiots" * 6
    docs += [(None, clean), (None, bad), (1000, clean + " x"), (1000, bad + " x")]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = corpus_pipeline.reject_toxic(spark, frame(spark, docs), str(tmp_path))
    assert kept.columns == frame(spark, []).columns
    got = {(r["doc_id"], r["text"]) for r in kept.collect()}
    assert {(None, clean), (1000, clean + " x")} <= got and not {(None, bad), (1000, bad + " x")} & got

    one, two, three = (words(rng, 80) for _ in range(3))
    rows = [(None, one), (None, two), (5, one), (7, three), (7, two + " y"), (9, three)]
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_copies(spark, frame(spark, rows), "").collect()]
    assert Counter(got) == Counter([(None, two), (5, one), (7, two + " y"), (9, three)])

    near = "a b c d"
    rows = [(None, near), (None, near.upper()), (None, two), (5, "A b c d"), (7, three), (7, "a B c d"), (8, None), (8, one)]
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_copies(spark, frame(spark, rows), "").collect()]
    assert Counter(got) == Counter([(None, two), (5, "A b c d"), (7, three), (8, None), (8, one)])
    # Components of null ids only, and two components whose smallest id is the same.
    rows = [(None, near), (None, near.upper()), (None, two), (None, two.upper()), (7, three), (7, one), (8, three.upper()), (8, one.upper())]
    got = Counter((r["doc_id"], r["text"].lower()) for r in corpus_pipeline.drop_near_copies(spark, frame(spark, rows), "").collect())
    assert got == Counter([(None, near), (None, two), (7, three), (7, one)])


def test_pipeline_keeps_one_row_of_copies(spark, tmp_path):
    rng = random.Random(5)
    repeated, no_id, mixed, alone = (words(rng, 90) for _ in range(4))
    rows = [(4, repeated), (4, repeated), (None, no_id), (None, no_id), (None, no_id), (None, mixed), (6, mixed), (None, alone), (9, None), (9, "")]
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    wanted = Counter([(4, repeated), (None, no_id), (6, mixed), (None, alone), (9, "")])
    docs = corpus_pipeline.stored(frame(spark, rows))
    near = [(r["doc_id"], r["text"] or "") for r in corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path)).collect()]
    assert Counter(near) == wanted
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, str(tmp_path)))
        got = Counter((r["doc_id"], r["text"] or "") for r in docs.collect())
        assert got == (Counter([(i, t or "") for i, t in rows]) if name == "toxicity" else wanted)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert sum(r["length"] for r in packed) == sum(len(t.split()) + 1 for _, t in wanted)


# --- rows without ids of their own ---


def test_texts_of_equal_short_hashes_stay_apart(spark, monkeypatch):
    """Rows that share what tells texts of an id apart, in 31 bits, are not cut for one another."""
    rng = random.Random(8)
    passage = words(rng, 80)
    texts = [f"{words(rng, 60)} {passage}", words(rng, 140), f"{passage} {words(rng, 50)}"]
    keyed = suffix_dedup._keyed
    monkeypatch.setattr(suffix_dedup, "_keyed", lambda docs: keyed(docs).withColumn("_tag", F.lit(7).cast("long")))
    found = suffix_dedup.removal_digests(frame(spark, [(None, t) for t in texts])).collect()
    removed = {r["n_bytes"]: r["n_removed"] for r in found}
    assert removed[len(texts[1])] == 0 and removed[len(texts[0])] > 200 and removed[len(texts[2])] > 200


def test_columns_that_clash_pass_unchanged(spark):
    rng = random.Random(9)
    shared = words(rng, 90)
    names = ["_text", "_doc", "_tag", "_spans", "_text_sha256", "_dropped_id", "row", "sha256", "dropped_id", "marks"]
    rows = [(i, f"{words(rng, 30)} {shared}" if i < 3 else "same", *[f"{n}{i}" for n in names]) for i in range(5)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, {', '.join(f'{n} string' for n in names)}")
    cut = suffix_dedup.cut_repeats(docs)
    assert cut.columns == docs.columns
    assert {r["doc_id"]: tuple(r)[2:] for r in cut.collect()} == {r[0]: r[2:] for r in rows}
    kept = corpus_pipeline.drop_copies(spark, docs, "")
    assert kept.columns == docs.columns
    assert {r["doc_id"]: tuple(r)[2:] for r in kept.collect()} == {r[0]: r[2:] for r in rows if r[0] != 3}
