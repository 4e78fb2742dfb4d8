"""Conversation repair, the prefix trie and decontamination against brute force."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from sqltrail.llm import conversation_repair as repair
from sqltrail.llm import conversation_trie as trie
from sqltrail.llm import decontamination as decon
from sqltrail.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string, block int, same string, kind string"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def turn_frame(spark, rows):
    return spark.createDataFrame([(*row, 9, "x", "y") for row in rows], TURNS)


def table(name):
    import pyarrow.parquet as pq

    return pq.read_table(f"{SF_DIR}/{name}.parquet").to_pylist()


# --- conversation repair ---

SPACE = " \t\n\x0b\x0c\r"


def damage_by_hand(rows):
    """Rows after damage by conversation, in order."""
    convs: dict = defaultdict(list)
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        kept = convs[conv]
        if fault == 0:
            continue
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        kept += [(turn, role, text)] * (2 if fault == 3 else 1)
    for conv, kept in convs.items():
        mark = "-" if conv is None else conv
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, sha(f"{mark}:{len(r[1])}:{r[1]}{r[2]}")))
    return convs


def faults_by_hand(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def repaired_by_hand(rows, faults):
    """Least (cost, audit) by shortest paths over (row, state), and the lines it leaves."""
    after = {("0", "s"): "1", ("0", "u"): "2", ("1", "u"): "2", ("2", "a"): "3", ("3", "u"): "2"}
    name = {"0": "user", "1": "user", "2": "assistant", "3": "user"}
    best = {(0, "0"): (0, "", ())}
    for i in range(len(rows) + 1):
        for _ in range(4):
            for state in "0123":
                if (i, state) in best:
                    cost, audit, lines = best[i, state]
                    to = (i, after[state, name[state][0]])
                    new = (cost + 5, audit + "I", (*lines, name[state] + ":"))
                    if to not in best or new[:2] < best[to][:2]:
                        best[to] = new
        if i == len(rows):
            break
        _, role, text = rows[i]
        for state in "0123":
            if (i, state) not in best:
                continue
            cost, audit, lines = best[i, state]
            options = [((i + 1, state), (cost + 2, audit + "D", lines))]
            if faults[i] not in ("blank", "duplicate"):
                more = 5 if faults[i] == "truncated" else 0
                options.append(((i + 1, after[state, name[state][0]]), (cost + 1 + more, audit + "R", (*lines, f"{name[state]}:{text}"))))
                if (state, role[:1]) in after:
                    options.append(((i + 1, after[state, role[:1]]), (cost + more, audit + "K", (*lines, f"{role}:{text}"))))
            for to, new in options:
                if to not in best or new[:2] < best[to][:2]:
                    best[to] = new
    cost, audit, lines = min(best[len(rows), s] for s in "03" if (len(rows), s) in best)
    return cost, audit, sha("\n".join(lines))


def repair_wanted(convs):
    out = {}
    for conv, rows in convs.items():
        faults = faults_by_hand(rows)
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        count = Counter(faults)
        out[conv] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, *repaired_by_hand(rows, faults))
    return out


def repair_found(frame):
    rows = frame.collect()
    found = {r["conv_id"]: tuple(r)[1:] for r in rows}
    assert len(found) == len(rows)
    return found


def random_turns(rng, convs, longest, nulls=0.0):
    texts = ["Yes.", "No", "Why?", "", " ", "Go!\n", "a. b", "Fine. ", "x" * 50 + ".", "ü.", "."]
    rows = []
    for conv in convs:
        for turn in range(rng.randrange(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "User"])
            row = [conv, rng.choice([turn, turn, turn * 2, None if rng.random() < nulls else turn]), role, rng.choice(texts) + rng.choice(["", "", f"{turn}."])]
            if rng.random() < nulls:
                row[rng.choice([2, 3])] = None
            rows.append(tuple(row))
            if rng.random() < 0.1:
                rows.append(tuple(row))
    return rows


def test_repair_equals_the_query_by_hand(spark):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in table("conversations")]
    assert repair_found(QUERIES["op11_conversation_repair"](spark, SF_DIR)) == repair_wanted(damage_by_hand(rows))


@pytest.mark.parametrize("held", [1, 7, 4096])
def test_repair_of_odd_conversations(spark, held):
    rng = random.Random(held)
    rows = random_turns(rng, [*range(40), None], 14, nulls=0.1) + random_turns(rng, [99], 160) + [(77, None, None, None)] * 9 + [(78, 3, "user", "Again.")] * 30
    rng.shuffle(rows)
    found = repair_found(repair.repaired_conversations(repair.damaged(turn_frame(spark, rows)), copies_col="copies", held_rows=held))
    assert found == repair_wanted(damage_by_hand(rows))


def test_repair_of_one_conversation_over_many_tasks(spark):
    rng = random.Random(5)
    rows = [(1, i, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "no", f"t{i}.", f"t{i}"])) for i in range(1500)]
    frame = turn_frame(spark, rows).repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = repair_found(repair.repaired_conversations(frame))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found == repair_wanted({1: [row[1:] for row in rows]})


def test_repair_of_all_edit_sequences():
    """Cells against every way to edit up to three turns."""
    for kinds in itertools.product([(i, f) for i in ("s", "u", "a", "") for f in ("", "blank", "truncated")], repeat=3):
        rows = [(n, {"s": "system", "u": "user", "a": "assistant", "": "tool"}[i], {"": f"t{n}.", "blank": "", "truncated": f"t{n}"}[f]) for n, (i, f) in enumerate(kinds)]
        cell = repair.parsed([repair.turn_cell(i, f) for i, f in kinds])
        assert repair.best_parse(cell)[:2] == repaired_by_hand(rows, faults_by_hand(rows))[:2]


def test_repair_of_no_rows(spark):
    assert repair.repaired_conversations(turn_frame(spark, [])).count() == 0
    (row,) = repair.repaired_conversations(turn_frame(spark, [(4, None, None, None)])).collect()
    assert tuple(row) == (4, 0, 1, 0, 0, 0, 2, "D", sha(""))


# --- prefix trie ---


def trie_wanted(rows):
    convs: dict = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv].append((turn, role or "", text or ""))
    for own in convs.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    rebuilt = {}
    for conv, own in convs.items():
        h = zlib.crc32(str("" if conv is None else conv).encode()) % 6
        lent = [] if conv is None else convs[conv - conv % 100][:h] if conv - conv % 100 in convs else []
        rebuilt[conv] = [t[1:] for t in [*lent, *own[h:]]]
    members = defaultdict(list)
    for conv, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
    order = lambda c: (c is None, c or 0)
    children = Counter(path[:-1] for path in members if path)
    leaves, saved = Counter(), Counter()
    for path, ids in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += children[path] == 0
            saved[path[:d]] += (len(ids) - 1) * len(path[-1][1]) if path else 0
    out = Counter()
    for path, ids in members.items():
        ends = sorted((c for c in ids if len(rebuilt[c]) == len(path)), key=lambda c: (c is not None, c or 0))
        parent = min(members[path[:-1]], key=order) if path else None
        out[min(ids, key=order), len(path), parent, len(ids), children[path], leaves[path], saved[path], sha(",".join("" if c is None else str(c) for c in ends))] += 1
    return out


def trie_found(spark, conversations, band=trie.BAND):
    turns, convs = trie.rebuilt_turns(conversations)
    return Counter(tuple(r) for r in trie.prefix_trie(turns, convs, band).collect())


def test_trie_equals_the_query_by_hand(spark):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in table("conversations")]
    assert Counter(tuple(r) for r in QUERIES["op12_prefix_trie"](spark, SF_DIR).collect()) == trie_wanted(rows)


@pytest.mark.parametrize("band", [2, 3, 16])
def test_trie_of_odd_conversations(spark, band):
    rng = random.Random(band)
    rows = []
    for conv in [*range(0, 12), *range(100, 130), *range(205, 215), None]:
        for turn in range(rng.choice([1, 2, 5, 9, 30])):
            rows.append((conv, turn - 1 if turn else None, rng.choice(["user", None]), rng.choice(["a", "bb", None])))
    rng.shuffle(rows)
    assert trie_found(spark, turn_frame(spark, rows), band) == trie_wanted(rows)


def test_trie_with_repeated_rows_and_copies(spark):
    rows = [(c, t, "user", "same") for c in range(300, 340) for t in range(7)] + [(7, 1, "user", "x")] * 5
    for blocks in (1, 8):
        assert trie_found(spark, turn_frame(spark, rows).repartition(blocks)) == trie_wanted(rows)


def test_ends_over_many_tasks(spark):
    """Ids of one node that are sorted into several tasks."""
    rows = [(c, 0, "user", "one") for c in range(1000, 1400)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert trie_found(spark, turn_frame(spark, rows)) == trie_wanted(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_trie_of_no_rows(spark):
    assert trie_found(spark, turn_frame(spark, [])) == Counter()


# --- decontamination ---


def words_of(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contamination_wanted(docs, items, window=10):
    windows = defaultdict(set)
    for item, text in items:
        words = words_of(text)
        m = min(window, len(words))
        for i in range(len(words) - m + 1 if words else 0):
            windows[tuple(words[i : i + m])].add("" if item is None else str(item))
    lengths = {len(w) for w in windows}
    out = Counter()
    for doc, text in docs:
        words, hit, found = words_of(text), set(), set()
        for m in lengths:
            for i in range(len(words) - m + 1):
                if (owners := windows.get(tuple(words[i : i + m]))) is not None:
                    hit |= set(range(i, i + m))
                    found |= owners
        out[doc, len(words), len(hit), tuple(sorted(found))] += 1
    return out


def contamination_found(frame):
    return Counter((r["doc_id"], r["n_words"], sum(s["after"] - s["first"] for s in r["spans"]), tuple(r["items"])) for r in frame.collect())


def test_contamination_equals_the_query_by_hand(spark):
    docs = [(r["doc_id"], r["text"]) for r in table("documents")]
    items = [(r["item_id"], r["text"]) for r in table("benchmark")]
    wanted = Counter()
    for (doc, n, n_hit, found), count in contamination_wanted(docs, items).items():
        wanted[doc, n, n_hit, len(found), sha(",".join(found)), n_hit > 0] += count
    assert any(key[5] for key in wanted)
    assert Counter(tuple(r) for r in QUERIES["op13_decontamination"](spark, SF_DIR).collect()) == wanted


def contamination_tables(rng):
    stock = [*"abcdefg", "Äh", "4x", "Zoé"]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(stock) for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 9, 10, 11, 40]) if i > 3 else 12)) for i in range(12)] + [(None, "a b c d e f g a b c d"), (5, ""), (6, None), (3, text(30)), (3, text(30))]
    items = [x for x in items if len(words_of(x[1])) != 1 or x[1] == "4x"]
    docs = [(i, text(rng.choice([0, 1, 5, 40, 300]))) for i in range(60)]
    docs += [(i, f"{text(5)}; {rng.choice(items)[1]} - {text(9)}") for i in range(60, 120)] + [(None, None), (None, "A B c. D/e f g a b c d e"), (1, "a"), (1, "a")]
    return docs, items


@pytest.mark.parametrize(("window", "most"), [(10, 2 << 20), (10, 300), (3, 2 << 20), (1, 100)])
def test_contamination_of_odd_texts(spark, window, most):
    docs, items = contamination_tables(random.Random(window + most))
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, n_words int, items string")
    bench = spark.createDataFrame([(i, t, "r") for i, t in items], "item_id long, text string, run string")
    found = decon.contaminated_words(frame, bench, window=window, most_bytes=most)
    assert contamination_found(found) == contamination_wanted(docs, items, window)


def test_slices_and_runs_lose_no_window(monkeypatch):
    rng = random.Random(3)
    docs, items = contamination_tables(rng)
    items.append((50, " ".join(rng.choice("abc") for _ in range(500))))
    docs.append((500, " ".join(rng.choice("abc") for _ in range(2000)) + items[-1][1]))
    monkeypatch.setattr(decon.word_slices, "__defaults__", (16,))
    monkeypatch.setattr(decon.item_runs, "__defaults__", (7,))
    runs = [("" if i is None else str(i), b" ".join(run).decode()) for i, t in items for run in decon.item_runs(t, 10)]
    tables = decon.searches(runs, 10)
    found = Counter()
    for doc, text in docs:
        n, spans, owners = decon.hits(text, tables, 10)
        found[doc, n, sum(b - a for a, b in spans), tuple(sorted(owners))] += 1
    assert found == contamination_wanted(docs, items)


def test_contamination_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert contamination_found(decon.contaminated_words(docs, bench.limit(0))) == Counter({(1, 2, 0, ()): 1, (2, 0, 0, ()): 1})
    assert decon.contaminated_words(docs.limit(0), bench).count() == 0
