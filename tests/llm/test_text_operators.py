"""Operators on single texts: toxicity, encoding, licences, token counts, class model, packing, I-Match."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sqltrail.llm import bpe, brown_lm, imatch, licenses, packing, token_counts, toxicity
from sqltrail.llm.queries import END_OF_TEXT, vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n int, held_out string, word string, fp string"


def frame(spark, rows):
    """Documents with nulls and with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, None, "s", None, 1, "x", "y", "z") for i, t in rows], DOCS)


ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "same text here"), (6, "same text here"), (6, "same text here"), (None, "no id"), (7, "x" * 5000), (8, "é漢😀 <|endoftext|> ok")]


# --- encoding ---


def texts(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    parts = [*"aeinrst  \n\t'.,0123éß漢\x1c\x85😀ABC#=-_<|>", "the", "ing", " and", "<|endoftext|>", "aaaa", "    ", "''ll", "'re"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_encoding_equals_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(vocabulary())
    coder = bpe.Encoder(vocabulary())
    some = [*texts(1, 3000), "", "a" * 3000, " " * 500, "ab" * 2000]
    for text, code, wanted in zip(some, coder.encode(some), library.encode_batch(some, add_special_tokens=False)):
        ids = np.frombuffer(code, "<u4")
        assert ids.tolist() == wanted.ids, text
        assert coder.pairs.decode(ids) == library.decode(wanted.ids, skip_special_tokens=False)


def test_words_are_forgotten_without_changing_results(monkeypatch):
    some = texts(2, 400)
    wanted = list(bpe.Encoder(vocabulary()).encode(some))
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    coder = bpe.Encoder(vocabulary())
    assert [c for i in range(0, 400, 50) for c in coder.encode(some[i : i + 50])] == wanted


def test_trie_shares_prefixes():
    trie = bpe.build_trie([b"abc", b"abd", b"ab", b"x"])
    assert [n.word[n.start : n.end] for n in trie.below] == [b"ab", b"x"]
    assert [n.word[n.start : n.end] for n in trie.below[0].below] == [b"c", b"d"] and trie.below[0].whole


def test_encode_documents(spark):
    found = bpe.encode_documents(frame(spark, ODD), vocabulary()).collect()
    assert sorted(r["decoded"] for r in found) == sorted(t or "" for _, t in ODD)
    assert all(r["n_tokens"] == len(r["ids"]) // 4 for r in found)
    digests = bpe.encode_documents(frame(spark, ODD), vocabulary(), digests=True).collect()
    assert Counter(r["ids_sha256"] for r in digests) == Counter(hashlib.sha256(r["ids"]).hexdigest() for r in found)
    assert bpe.encode_documents(frame(spark, []), vocabulary()).count() == 0


# --- token counts ---


def test_token_counts_of_files(spark):
    rows = [*ODD, *enumerate(texts(3, 100), 20)]
    folder = token_counts.write_token_files(frame(spark, rows).repartition(3), vocabulary(), END_OF_TEXT)
    coder = bpe.Encoder(vocabulary(), special=False)
    wanted = sorted(len(c) // 4 for c in coder.encode([t or "" for _, t in rows]))
    for tokens, runs in ((64, 2), (1 << 20, 1024), (1, 3)):
        found = token_counts.count_tokens(token_counts.token_blocks(spark, folder, block_tokens=tokens), END_OF_TEXT, block_tokens=tokens, run_blocks=runs).collect()
        assert sorted(r["n_tokens"] for r in found) == wanted and all(r["ended"] for r in found)
        by_file: dict = {}
        for r in sorted(found, key=lambda r: (r["file"], r["doc_no"])):
            number, start = by_file.get(r["file"], (0, 0))
            assert (r["doc_no"], r["start"]) == (number, start)
            by_file[r["file"]] = number + 1, start + r["n_tokens"] + 1


def test_token_counts_with_a_rest(spark):
    ids = np.array([5, 9, 9, 5, 5, 5, 5], "<u2")
    blocks = spark.createDataFrame([("f", i, ids[2 * i : 2 * i + 2].tobytes()) for i in range(4)], "file string, block int, data binary")
    found = token_counts.count_tokens(blocks, 9, block_tokens=2, run_blocks=1).orderBy("doc_no").collect()
    assert [(r["doc_no"], r["start"], r["n_tokens"], r["ended"]) for r in found] == [(0, 0, 1, True), (1, 2, 0, True), (2, 3, 4, False)]
    assert token_counts.count_tokens(blocks.where("false"), 9).count() == 0


# --- licences ---


def words_by_hand(text: str) -> list[str]:
    return "".join(c if c.isalpha() or c.isnumeric() else " " for c in text.lower()).split()


def dice_by_hand(one: str, two: str) -> float:
    def pairs(text):
        words = words_by_hand(text)
        return Counter(zip(words, words[1:])) if len(words) > 1 else Counter((w, None) for w in words)

    a, b = pairs(one), pairs(two)
    return 2 * sum((a & b).values()) / (sum(a.values()) + sum(b.values())) if a and b else 0.0


def passages_by_hand(text: str, template: str) -> dict[int, float]:
    (a, b), votes = (list(zip(w, w[1:])) for w in (words_by_hand(text), words_by_hand(template))), Counter()
    seeds: dict = {}
    for q in range(len(b) - 1):
        seeds.setdefault((b[q], b[q + 1]), []).append(q)
    for p in range(len(a) - 1):
        for q in seeds.get((a[p], a[p + 1]), []):
            votes[p - q] += 1
    found = {}
    for d, n in votes.items():
        if all((votes[e], -e) <= (n, -d) for e in votes if abs(e - d) < len(b)):
            inside = a[max(d, 0) : d + len(b)]
            found[max(d, 0)] = 2 * sum((Counter(inside) & Counter(b)).values()) / (len(inside) + len(b))
    return {d: dice for d, dice in found.items() if dice >= 0.8}


def test_licenses_against_brute_force(spark):
    mit = licenses.TEMPLATES["MIT"][2]
    cut = mit.split(". ")
    rows = [
        *ODD, (20, "intro\nLICENSED under the apache-license; version 2.0\nend"), (21, "Licensed under CC BY 4.0."), (22, mit),
        (23, "some prose\n\n" + ".\n".join(cut) + "\n\nmore prose"), (24, "Licensed. " * 40), (25, "this work is licensed under the gnu general public license version 9"),
        (26, "\n".join(mit.split(" ")[i] for i in range(len(mit.split(" "))))),
    ]
    found = {(r["doc_id"], r["kind"], r["number"], r["license"], r["template"]): r["dice"] for r in licenses.scan_licenses(frame(spark, rows)).collect()}
    wanted = {}
    for i, text in rows:
        paragraphs = (text or "").split("\n\n")
        units = [("line", n, x) for n, x in enumerate(x for p in paragraphs for x in p.split("\n"))]
        units += [("paragraph", n, p) for n, p in enumerate(paragraphs) if "\n" in p]
        units += [("text", 0, text)] if len(paragraphs) > 1 else []
        for kind, n, unit in units:
            for name, templates in licenses.TEMPLATES.items():
                for t, template in enumerate(templates):
                    if (dice := dice_by_hand(unit, template)) >= 0.8:
                        wanted[i, kind, n, name, t] = dice
        for name, templates in licenses.TEMPLATES.items():
            for t, template in enumerate(templates):
                wanted |= {(i, "passage", d, name, t): dice for d, dice in passages_by_hand(text or "", template).items()}
    assert found.keys() == wanted.keys() and len(wanted) > 6
    assert all(abs(found[k] - wanted[k]) < 1e-12 for k in wanted)
    assert licenses.scan_licenses(frame(spark, [])).count() == 0


def test_license_passages(spark):
    rng = random.Random(5)
    mit, apache = licenses.TEMPLATES["MIT"][2], licenses.TEMPLATES["Apache-2.0"][1]
    prose = lambda n: " ".join(rng.choice(["of", "the", "software", "in", "red", "green", "under", "this", "apple"]) for _ in range(n))
    words = mit.split(" ")
    three = "\n".join(words[:60]) + "\n\n" + " ".join(words[60:110]) + " \n \n" + " ".join(words[110:])
    changed = " ".join(w for i, w in enumerate(words) if i % 25 != 7)
    rows = [
        (1, prose(2000) + "\n" + three + "\n" + prose(2000)), (2, f"{prose(40)}. {apache} {prose(40)}"), (3, f"{mit} {mit}\n{mit}"),
        (4, f"Copyright 2024 Example Authors. All rights reserved. {licenses.TEMPLATES['Apache-2.0'][0]} Copied from {licenses.TEMPLATES['MIT'][1]}"),
        (5, prose(3000)), (6, prose(300) + changed + prose(300)), (7, " ".join(words[8:])), (None, prose(9) + mit), (8, "a"), (9, None),
        (10, (mit + " ") * 40 + prose(30000) + apache),
    ]
    found = {}
    for r in licenses.scan_licenses(frame(spark, rows)).where("kind = 'passage'").collect():
        found.setdefault((r["doc_id"], r["license"], r["template"]), {})[r["number"]] = round(r["dice"], 9)
    wanted = {}
    for i, text in rows:
        for name, templates in licenses.TEMPLATES.items():
            for t, template in enumerate(templates):
                if got := passages_by_hand(text or "", template):
                    wanted[i, name, t] = {d: round(dice, 9) for d, dice in got.items()}
    assert found == wanted
    assert found[1, "MIT", 2] == {2000: 1.0} and list(found[2, "Apache-2.0", 1].values()) == [1.0] and len(found[3, "MIT", 2]) == 3
    assert found[4, "Apache-2.0", 0] == {7: 1.0} and (4, "MIT", 1) in found and (6, "MIT", 2) in found and (7, "MIT", 2) in found
    assert len(found[10, "MIT", 2]) == 40 and not any(key[0] == 5 for key in found)


# --- toxicity ---


def labelled(spark, n=1500):
    rng = random.Random(5)
    stock = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(stock) for _ in range(rng.randint(20, 120))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["gronkvile", "zuckhexer", "wormspit"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark):
    rows, labels = labelled(spark)
    odd = [(5000, None), (5001, ""), (5002, "x" * 20000), (None, "no id")]
    found = {r["doc_id"]: r for r in toxicity.toxicity_scores(frame(spark, rows + odd), labels).collect()}
    assert len(found) == len(rows) + 4
    held = [r for i, r in found.items() if i is not None and i < 5000 and zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(r["held_out"] for r in held) and all(0 <= r["score"] <= 1 for r in found.values())
    toxic, clean = ([r["score"] for r in held if (r["doc_id"] % 5 == 0) == t] for t in (True, False))
    above = np.mean([(t > c) + 0.5 * (t == c) for t in toxic for c in clean])
    assert above > 0.85 and np.mean([c < 0.5 for c in clean]) > 0.95
    assert all((r["score"] >= 0.5) == r["predicted"] for r in found.values())


def test_toxicity_without_labels(spark):
    rows, labels = labelled(spark, 20)
    found = toxicity.toxicity_scores(frame(spark, rows), labels.where("false")).collect()
    assert {(r["score"], r["predicted"]) for r in found} == {(0.0, 0)}
    assert toxicity.toxicity_scores(frame(spark, []), labels).count() == 0


def test_windows_hold_the_whole_text():
    for text in (b"", b"a b c", b"x" * 1000, " ".join("wörter" for _ in range(200)).encode()):
        assert b"".join(toxicity.windows(text)) == text.lower()


# --- class model ---


def test_class_model(spark):
    rng = random.Random(3)
    nouns, verbs = [f"n{i}" for i in range(30)], [f"v{i}" for i in range(30)]
    rows = [(i, " ".join(f"The {rng.choice(nouns)} {rng.choice(verbs)}" for _ in range(20))) for i in range(300)] + ODD[:7] + ODD[8:]
    tokens = [(i, (t or "").encode().lower().split()) for i, t in rows]
    training = [zlib.crc32(str(i).encode() if i is not None else b"") % 7 != 2 for i, _ in rows]
    counts = Counter(w for (_, ws), t in zip(tokens, training) if t for w in ws)
    ends = sum(training)
    n, v = sum(counts.values()) + ends, len(counts) + 1
    found = brown_lm.class_model_scores(frame(spark, rows)).collect()
    wanted = Counter()
    for (i, ws), t in zip(tokens, training):
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws) + math.log10((ends + 1) / (n + v + 1))
        wanted[i, not t, len(ws) + 1, sum(counts[w] > 0 for w in ws) + 1, n, round(base, 6)] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found) == wanted
    held = [r for r in found if r["held_out"] and r["n_tokens"] > 50]
    assert held and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert brown_lm.class_model_scores(frame(spark, [])).count() == 0


def test_words_that_are_not_sent_score_alike(spark, monkeypatch):
    rows = [(i, f"a b w{i % 40} W{i % 7} rare{i}.") for i in range(200)]
    key = lambda r: (r["doc_id"], r["n_known"], round(r["base_score"], 9))
    wanted = sorted(map(key, brown_lm.class_model_scores(frame(spark, rows)).collect()))
    monkeypatch.setattr(brown_lm, "SENT_WORDS", 10)
    assert sorted(map(key, brown_lm.class_model_scores(frame(spark, rows)).collect())) == wanted


def sentences(n: int, kinds: int = 3, size: int = 40) -> list[str]:
    """Words of a few kinds in a fixed order of kinds; most are rarer than the head of the clustering."""
    rng = random.Random(4)
    return [" ".join(f"{'abcdef'[k]}{int(size * rng.random() ** 2):03d}" for k in [j % kinds for j in range(rng.randint(0, 30))]) for _ in range(n)]


def test_class_probabilities_sum_to_one(spark, monkeypatch):
    assert brown_lm.class_model_scores(frame(spark, [(i, None) for i in range(5)])).where("score > 0 OR score IS NULL").count() == 0
    monkeypatch.setattr(brown_lm, "CLUSTERED", 12)
    monkeypatch.setattr(brown_lm, "CLASSES", 3)
    monkeypatch.setattr(brown_lm, "LEAST_LEARNT", 5)
    rows = [*ODD, *enumerate(sentences(400), 100), (99, "once twice, 5 é")]
    model = brown_lm.fit_classes(*brown_lm.training_rows(frame(spark, rows))[1:])
    assert np.allclose((10.0**model.moves).sum(1), 1)
    training = [brown_lm.tokens((t or "").encode()) for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter(w for ws in training for w in ws)
    end = len(model.moves) - 1
    kind = lambda w: int(model.kinds[model.words.index[w]]) if w in model.words.index else model.first_shape + brown_lm.shape(w)
    learnt = {w for w in counts if kind(w) < model.first_shape}
    assert {w for w in counts if counts[w] >= 5} <= learnt and len(learnt) > 60
    # Words of one kind come into one class, whether in the head or not.
    assert all(len({kind(w) for w in learnt if w[:1] == letter}) == 1 for letter in (b"a", b"b", b"c"))
    pairs = Counter()
    for ws in training:
        kinds = [end, *map(kind, ws), end]
        pairs.update(zip(kinds, kinds[1:]))
    seen, total = Counter(), sum(pairs.values())
    for (_, b), n in pairs.items():
        seen[b] += n
    before = Counter()
    for (a, _), n in pairs.items():
        before[a] += n
    types = Counter(kind(w) for w in counts if w not in learnt)

    def by_hand(ws):
        score, last = 0.0, end
        for w in [*ws, None]:
            k = end if w is None else kind(w)
            prior = brown_lm.PRIOR * (seen[k] + 1) / (total + end + 1)
            score += math.log10((pairs[last, k] + prior) / (before[last] + brown_lm.PRIOR))
            if w is not None:
                score += math.log10(counts[w] / seen[k] if w in learnt else (counts[w] + 1) / (seen[k] + types[k] + 1))
            last = k
        return score

    wanted = Counter((i, round(by_hand(brown_lm.tokens((t or "").encode())), 6)) for i, t in rows)
    found = brown_lm.class_model_scores(frame(spark, rows)).collect()
    assert Counter((r["doc_id"], round(r["score"], 6)) for r in found) == wanted


def test_learnt_classes_lower_the_perplexity(spark, monkeypatch):
    monkeypatch.setattr(brown_lm, "CLUSTERED", 30)
    monkeypatch.setattr(brown_lm, "CLASSES", 3)
    docs = frame(spark, list(enumerate(sentences(800, size=200))))

    def perplexity(column):
        held = brown_lm.class_model_scores(docs).where("held_out").agg(F.sum(column), F.sum("n_tokens")).first()
        return 10 ** (-held[0] / held[1])

    learnt = perplexity("score")
    assert learnt < 0.6 * perplexity("base_score")
    monkeypatch.setattr(brown_lm, "ROUNDS", 0)
    assert learnt < 0.8 * perplexity("score")


def test_exchange_finds_classes():
    rng = np.random.default_rng(1)
    pairs = np.zeros((12, 12), int)
    for a in rng.integers(0, 10, 4000):
        pairs[a, (a % 2 == 0) + 2 * rng.integers(0, 5)] += 1
    at = brown_lm.exchange(pairs, 10, classes=2, sweeps=10)
    assert len(set(at[[0, 2, 4, 6, 8]])) == 1 and len(set(at[[1, 3, 5, 7, 9]])) == 1 and at[10] != at[11]


# --- packing ---


def test_packing_keeps_every_token(spark):
    rows = [*ODD, (30, "w " * 20000), *((i, "w " * (i % 900)) for i in range(100, 400))]
    found = packing.pack_documents(frame(spark, rows)).collect()
    wanted = Counter()
    for i, t in rows:
        wanted[i] += len((t or "").encode().split()) + 1
    got, bins = Counter(), {}
    for r in found:
        got[r["doc_id"]] += r["length"]
        bins.setdefault((r["shard"], r["bin"]), []).append(r)
    assert got == wanted
    for rows_ in bins.values():
        used = 0
        for r in sorted(rows_, key=lambda r: r["offset"]):
            assert r["offset"] == used
            used += r["length"]
        capacity = rows_[0]["capacity"]
        assert used <= capacity and all(c < used for c in packing.CAPACITIES if c < capacity)
    assert sum(r[0]["capacity"] for r in bins.values()) < 1.1 * sum(wanted.values()) + 8192
    assert packing.pack_documents(frame(spark, [])).count() == 0


def test_best_fit_takes_the_fullest_bin_that_has_room():
    bins, offsets, sizes = packing.best_fit(np.array([7, 6, 3, 2, 1]), [4, 10])
    assert (bins, offsets) == ([0, 1, 0, 1, 1], [0, 0, 7, 6, 8]) and sizes == [10, 10]


# --- I-Match ---


def test_imatch_neighbours_and_edits(spark):
    rng = random.Random(9)
    stock = [f"wort{i}" for i in range(3000)]
    rows = [(i * 3, " ".join(rng.choice(stock) for _ in range(rng.randint(20, 300)))) for i in range(400)] + [(2, None), (4, ""), (5, "a"), (7, "öäü😀")]
    found = {r["doc_id"]: r for r in imatch.edited_likeness(frame(spark, rows)).collect()}
    ordered = sorted(((i, t or "") for i, t in rows), reverse=True)
    for (i, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        assert found[i]["n_chars"] == len(text)
        assert found[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    assert len(found) == len(rows) and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in found.values())
    long = [r for r in found.values() if r["n_chars"] > 500]
    assert np.mean([r["near_edited"] for r in long]) > 0.2 > 0.05 > np.mean([r["near_next"] for r in long])


def test_imatch_shows_a_change_of_any_term_and_tells_texts_without_terms_apart(spark):
    rng = random.Random(12)
    stock = [f"wort{i}" for i in range(600)]
    base = rng.sample(stock, 200)
    rows = [(i, " ".join(rng.sample(stock, 5))) for i in range(1000)]
    rows += [(2000 + i, " ".join(base[:i] + base[i + 1 :])) for i in range(60)]
    rows += [(3000, "einzig"), (3001, "allein hier"), (3002, ""), (3003, None), (3004, "einzig")]
    prints = {r["doc_id"]: r["text"] for r in imatch.imatch_fingerprints(frame(spark, rows)).select("doc_id", imatch.as_text(F.col("fingerprint")).alias("text")).collect()}
    # Of the 60 texts each lacks another word.
    assert len({prints[2000 + i] for i in range(60)}) == 60
    assert len({prints[3000], prints[3001], prints[3002]}) == 3
    assert prints[3000] == prints[3004] and prints[3002] == prints[3003]


def test_imatch_equal_texts_ties_and_nulls(spark):
    rows = [(1, "one two three"), (2, "one two three"), (2, "one two three"), (3, None), (None, "one two three"), (None, "other")]
    found = imatch.edited_likeness(frame(spark, rows)).collect()
    assert len(found) == 6
    assert len({r["fingerprint"] for r in found if r["n_chars"] == 13}) == 1
    assert imatch.edited_likeness(frame(spark, [])).count() == 0
    alone = imatch.edited_likeness(frame(spark, [(1, "abcdef")])).first()
    assert alone["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and alone["near_next"] == 1.0
    assert imatch.imatch_fingerprints(frame(spark, rows)).select(F.col("fingerprint.level")).count() == 6


# --- bounds and row keys ---


def test_licenses_of_rows_without_ids_stay_apart(spark):
    halves = ["licensed under the apache license under the mit", "the mit license version 2 0 licensed under"]
    assert licenses.scan_licenses(frame(spark, [(None, t) for t in halves])).count() == 0
    whole = licenses.TEMPLATES["MIT"][0]
    alone = licenses.scan_licenses(frame(spark, [(1, whole)])).collect()
    assert sorted(map(tuple, licenses.scan_licenses(frame(spark, [(1, whole)] * 2)).collect())) == sorted([tuple(r) for r in alone] * 2)


def test_labelled_sample_is_bounded_for_a_repeated_id(spark):
    docs = frame(spark, [(4, f"text {i}") for i in range(300)] + [(4, "the same")] * 300 + [(9, "a"), (10, "b")])
    labels = spark.createDataFrame([(4, 1), (9, 0), (10, 0)], "doc_id long, toxic int")
    sample, _ = toxicity.labelled_sample(docs, labels, rows=20)
    assert len(sample) <= 20
    sample, _ = toxicity.labelled_sample(docs, labels, rows=1000)
    assert sum(t == b"the same" for t, _, _ in sample) <= 1


def test_equal_rows_are_dealt_to_several_shards(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_TOKENS", 100)
    docs = frame(spark, [(None, "a b c")] * 300).repartition(4)
    found = packing.pack_documents(docs).groupBy("shard").count().collect()
    assert len(found) > 6 and max(r["count"] for r in found) < 150


@pytest.mark.parametrize("most", [1, 5, 40, 200, 10_000])
def test_words_that_are_sent_are_bounded(spark, most):
    counts = [1] * 100 + [2] * 30 + [3, 3, 5, 9, 17, 900, 901, 5000]
    table = spark.createDataFrame([(bytes([i % 256, i // 256]), n) for i, n in enumerate(counts)], "word binary, n long")
    least = brown_lm.least_sent(table, most)
    sent = sum(n >= least for n in counts)
    assert sent <= most
    below = max((n for n in counts if n < least), default=None)
    assert below is None or sum(n >= below for n in counts) > most
