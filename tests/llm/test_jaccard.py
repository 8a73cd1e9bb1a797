import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tokentide.llm import jaccard

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if len(words) >= 5 else frozenset([tuple(words)])


def brute(rows, percent=75):
    sets = [(i, shingles(t)) for i, t, *_ in rows]
    root = list(range(len(sets)))

    def top(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            o = len(a & b)
            if a and b and 100 * o >= percent * (len(a) + len(b) - o):
                root[top(x)] = top(y)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[top(k)] = min(least.get(top(k), i), i)
    return sorted((i, len(s), least[top(k)]) for k, (i, s) in enumerate(sets))


def found(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def test_against_brute_force(docs, corpus):
    want = brute(corpus)
    assert found(jaccard.linked_documents(docs)) == want
    assert len({c for _, _, c in want}) < len(want) - 5


def drifting(rng, n):
    """Groups of near copies in which some pairs link only through others, and documents that share one passage."""
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    rows = []
    for _ in range(3):
        now = [word() for _ in range(120)]
        for _ in range(n):
            rows.append(list(now))
            now[rng.randrange(120)] = word()
    passage = [word() for _ in range(60)]
    rows += [passage + [word() for _ in range(rng.randint(5, 90))] for _ in range(n)]
    return [(k, " ".join(w)) for k, w in enumerate(rows)]


@pytest.mark.parametrize("wide,common", [(5, 10**6)])
def test_wide_columns_lose_no_link(spark, monkeypatch, wide, common):
    monkeypatch.setattr(jaccard, "WIDE", wide)
    monkeypatch.setattr(jaccard, "COMMON", common)
    rows = drifting(random.Random(wide), 30)
    assert found(jaccard.linked_documents(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def apart(rng, n):
    """A large group that shares most of its text and stays below the threshold, with a few real copies among them."""
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    passage = [word() for _ in range(100)]
    rows = [passage + [word() for _ in range(34)] for _ in range(n)]
    rows += [r[:-1] + [word()] for r in rows[:5]]
    return [(k, " ".join(w)) for k, w in enumerate(rows)]


def test_large_group_that_stays_apart(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "WIDE", 8)
    monkeypatch.setattr(jaccard, "TURNS", 1)
    made = []
    plain = jaccard._possible
    monkeypatch.setattr(jaccard, "_possible", lambda pairs, *a: made.append(pairs.count()) or plain(pairs, *a))
    rows = apart(random.Random(3), 120)
    assert found(jaccard.linked_documents(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
    # Of about 7,000 pairs that share the passage few are put out.
    assert made[-1] < 800


def test_shared_passages_below_the_sample_meet_no_row(spark, monkeypatch):
    """Columns of several rows that the sample doesn't show: rows with enough columns of their own put out no pair."""
    monkeypatch.setattr(jaccard, "COMMON", 10**6)
    made = []
    plain = jaccard._possible
    monkeypatch.setattr(jaccard, "_possible", lambda pairs, *a: made.append(pairs.count()) or plain(pairs, *a))
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    passage = [word() for _ in range(30)]
    rows = [passage + [word() for _ in range(270)] for _ in range(40)]
    rows += [r[:-1] + [word()] for r in rows[:3]]
    rows = [(k, " ".join(w)) for k, w in enumerate(rows)]
    assert found(jaccard.linked_documents(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
    # Of 903 pairs that share the passage.
    assert made[0] < 30


def test_pair_of_wide_columns_is_put_out_once(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "WIDE", 8)
    monkeypatch.setattr(jaccard, "TURNS", 0)
    made = []
    plain = jaccard._possible
    monkeypatch.setattr(jaccard, "_possible", lambda pairs, *a: made.append([r[:2] for r in pairs.collect()]) or plain(pairs, *a))
    rows = drifting(random.Random(5), 30)
    assert found(jaccard.linked_documents(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
    assert len(made) == 2 and len(made[-1]) == len(set(made[-1])) > 0


def test_signatures_drop_no_link(spark):
    rng = random.Random(9)
    rows = drifting(rng, 25) + [(900 + k, t) for k, t in apart(rng, 20)]
    df = spark.createDataFrame(rows, "cid long, text string")
    signs = {r.cid: int.from_bytes(r.sign) for r in df.mapInArrow(jaccard._signatures, "cid long, sign binary").collect()}
    sets = [(i, shingles(t)) for i, t in rows]
    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            assert len(a ^ b) >= (signs[i] ^ signs[j]).bit_count()


def test_edge_tables(no_docs, null_rows):
    assert jaccard.linked_documents(no_docs).collect() == []
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.linked_documents(null_rows).collect()}
    assert got == {(None, 0, None), (None, 1, None), (5, 0, 5), (7, 1, 7)}


def test_sets_are_made_once(docs, monkeypatch):
    plans, stage = {}, jaccard.stage
    monkeypatch.setattr(jaccard, "stage", lambda df, name: plans.update({name: df._jdf.queryExecution().toString()}) or stage(df, name))
    members, one = jaccard.classes(docs)
    assert [name for name, plan in plans.items() if "_digest" in plan] == ["digests"]
    assert members.count() == docs.count() and one.select("digest").distinct().count() == one.count()


def test_short_and_long_texts_in_one_column():
    texts = ["a b c d e f e", None, "x y", "a a a a a a", "", "X Y", "z", "a b c d e f e"]
    s = jaccard.Sets(pa.array(texts))
    sets = [s.values[a:b].tolist() for a, b in zip(s.first[:-1], s.first[1:], strict=True)]
    assert [len(x) for x in sets] == [3, 0, 1, 1, 0, 1, 1, 3] == s.count.tolist()
    assert sets[0] == sets[7] == sorted(sets[0]) and sets[2] == sets[5] != sets[6]
    assert np.array_equal(s.row, np.repeat(np.arange(8), s.count))
