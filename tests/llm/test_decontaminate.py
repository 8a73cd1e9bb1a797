import random
import re
from collections import Counter

import pytest

from tokentide.llm import decontaminate

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]


def shingles(w, width):
    return Counter(tuple(w[k : k + width]) for k in range(len(w) - width + 1))


def brute(rows, items, percent=75):
    out = {}
    for i, t, *_ in rows:
        w = words(t)
        for j, it in items:
            own = words(it)
            n, width = len(own), min(5, len(own))
            best = (0, 0)
            for k in range(max(1, len(w) - n + 1)) if own and w else ():
                a, b = shingles(w[k : k + n], width), shingles(own, width)
                least = sum((a & b).values())
                total = sum(a.values()) + sum(b.values()) - least
                if total:
                    best = max(best, (least / total, -k))
            if best[0] * 100 >= percent:
                out[i, j] = (round(best[0], 9), -best[1])
    return out


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 5))) for _ in range(400)]
    prose = lambda n: rng.choices(vocabulary, k=n)
    items = [(k, " ".join(prose(rng.choice([12, 20, 33, 50])))) for k in range(12)] + [(90, "two Words"), (91, None), (92, ""), (93, "w " * 30)]
    docs = [(0, None), (1, ""), (2, "TWO words"), (3, "w " * 200)]
    for k, text in items[:12]:
        w = text.split()
        docs.append((len(docs), " ".join(prose(40) + w + prose(60)).upper()))
        edit = list(w)
        edit[len(w) // 3] = "edited"
        docs.append((len(docs), " ".join(prose(9) + edit[: len(w) // 2] + edit[len(w) // 2 :] + prose(5))))
        docs.append((len(docs), " ".join(w[: int(len(w) * 0.9)])))
        docs.append((len(docs), " ".join(prose(50) + w[: len(w) // 2] + prose(50))))
    docs += [(len(docs) + k, " ".join(prose(150))) for k in range(30)]
    return docs, items


def found(df):
    return {(r.doc_id, r.item_id): (round(r.similarity, 9), r.first_word) for r in df.collect()}


def test_against_brute_force(spark, cases, monkeypatch):
    docs, items = cases
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, item string, words int")
    want = brute(docs, items)
    assert found(decontaminate.matches(frame, spark.createDataFrame(items, "item_id long, text string"))) == want
    assert len(want) > 20
    monkeypatch.setattr(decontaminate, "ITEMS_PER_BLOCK", 5)
    assert found(decontaminate.matches(frame, spark.createDataFrame(items, "item_id long, text string"))) == want
    kept = {r.doc_id for r in decontaminate.clean(frame, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}


def test_edge_tables(spark, no_docs, null_rows):
    items = spark.createDataFrame([(1, "a b"), (1, "a b")], "item_id long, text string")
    assert decontaminate.matches(no_docs, items).collect() == []
    assert decontaminate.matches(null_rows, items.limit(0)).collect() == []
    assert [(r.doc_id, r.similarity) for r in decontaminate.matches(null_rows, items).collect()] == [(None, 1.0), (None, 1.0)]
