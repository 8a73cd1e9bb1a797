import re

from tokentide.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(corpus):
    hosts, lines = {}, {}
    for i, t, h in corpus:
        hosts.setdefault(h or "", set()).add((i, t or ""))
        for line in (t or "").split("\n"):
            normal = tuple(re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(line))
            if normal:
                lines.setdefault((h or "", normal), set()).add(i)
    frequent = {k: min(v) for k, v in lines.items() if len(v) > 10 and len(v) > 0.05 * len(hosts[k[0]])}
    out = {}
    for i, t, h in corpus:
        t = t or ""
        words = WORD.findall(t)
        wins = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
        cover = {j for k, w in enumerate(wins) if wins.count(w) > 1 for j in range(k, k + 8)} if len(words) < 1000 else set()
        seen, dup, gone = set(), 0, 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
                normal = tuple(re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(line))
                if frequent.get((h or "", normal), i) != i:
                    gone += len(normal)
        failed = len(words) < 20 or 100 * len(cover) > 30 * len(words)
        left = len(words) - gone
        kept = not failed and not (gone and (left < 20 or left < 0.2 * len(words)))
        out[i] = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover), failed, kept, gone)
    return out


def test_against_brute_force(docs, corpus):
    got = {
        r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, r.removed_words)
        for r in quality.verdicts(docs).collect()
    }
    want = brute(corpus)
    assert got == want
    assert any(v[7] for v in want.values()) and any(v[5] for v in want.values()) and any(v[3] for v in want.values())


def test_clean_removes_lines_and_documents(docs, corpus):
    kept = {r.doc_id: r for r in quality.clean(docs).collect()}
    want = {i for i, v in brute(corpus).items() if v[6]}
    assert set(kept) == want
    with_line = [r for r in kept.values() if "Shared  Line" in r.text]
    assert 0 < len(with_line) <= 6 and all(r.n_chars == len(r.text) for r in kept.values())


def test_depleted_documents_go(spark):
    # A menu without a repeated window of eight words, so that only its frequency tells it from text.
    menu = "\n".join(" ".join("menu%d-%d" % (k, j) for j in range(12)) for k in range(4))
    rows = [(k, menu + "\nown %d" % k, "h") for k in range(15)] + [(50, "some other words and %s" % " ".join(map(str, range(40))), "h")]
    got = {r.doc_id: r for r in quality.verdicts(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(r.base_failed for r in got.values())
    assert [i for i, r in sorted(got.items()) if r.kept] == [0, 50]


def test_edge_tables(no_docs, null_rows):
    assert quality.verdicts(no_docs).collect() == []
    assert quality.clean(no_docs).collect() == []
    assert len(quality.verdicts(null_rows).collect()) == 6
