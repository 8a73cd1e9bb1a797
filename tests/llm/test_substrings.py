import hashlib
from collections import Counter

from tokentide.llm import substrings


def brute(corpus, width=35):
    words = [(i, (t or "").encode().split()) for i, t, *_ in corpus]
    count = Counter(tuple(w[k : k + width]) for _, w in words for k in range(len(w) - width + 1))
    out = []
    for i, w in words:
        gone = {j for k in range(len(w) - width + 1) if count[tuple(w[k : k + width])] > 1 for j in range(k, k + width)}
        left = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=repr)


def test_against_brute_force(docs, corpus):
    want = brute(corpus)
    assert found(substrings.removed_windows(docs)) == want
    assert sum(0 < r[2] < r[1] for r in want) > 5


def test_other_widths(docs, corpus):
    for width in (3, 8):
        assert found(substrings.removed_windows(docs, width)) == brute(corpus, width)


def test_text_is_what_is_left(docs):
    for r in substrings.removed_windows(docs, with_text=True).collect():
        assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256


def test_edge_tables(no_docs, null_rows):
    assert substrings.removed_windows(no_docs).collect() == []
    got = {(r.doc_id, r.n_words, r.n_removed) for r in substrings.removed_windows(null_rows).collect()}
    assert got == {(None, 0, 0), (None, 2, 0), (5, 0, 0), (7, 60, 60)}


def test_nothing_is_broadcast(docs, monkeypatch):
    plans, real = [], substrings.stage

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    monkeypatch.setattr(substrings, "stage", lambda df, name: plans.append(plan(df)) or real(df, name))
    plans.append(plan(substrings.removed_windows(docs)))
    assert sum("SortMergeJoin" in p for p in plans) >= 6
    assert not [p for p in plans if "Broadcast" in p]
