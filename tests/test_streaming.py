import json

from tokentide.operators import parse, pricing
from tokentide.streaming import incremental as X

from conftest import at


def test_usage_by_bucket(spark, tmp_path):
    folder = tmp_path / "sessions"
    folder.mkdir()
    for n in range(3):
        lines = [
            {"type": "event_msg", "timestamp": at(h).isoformat(), "payload": {"type": "token_count", "info": {"last_token_usage": {"input_tokens": n + 1, "output_tokens": 0}}}}
            for h in (0.1, 0.2, 1.5)
        ]
        (folder / f"rollout-2026-05-10T00-00-00-s{n}.jsonl").write_text("\n".join(map(json.dumps, lines)))
    events = parse.parse_lines(X.read_line_stream(spark, str(folder), 1))
    out = X.usage_by_bucket(pricing.price(X.line_usage(events, "gpt-5.5")))
    run = out.writeStream.outputMode("update").format("memory").queryName("buckets").option("checkpointLocation", str(tmp_path / "cp")).start()
    run.processAllAvailable()
    run.stop()
    got = spark.sql("SELECT start, max(calls) AS calls, max(total_tokens) AS tokens FROM buckets GROUP BY start ORDER BY start").collect()
    assert [(r.calls, r.tokens) for r in got] == [(6, 12), (3, 6)]


def test_lines_end_in_one_batch_only(tmp_path):
    import io
    import random

    from tokentide.streaming import follow

    rng = random.Random(2)
    data = b"".join(b"x" * rng.choice([0, 1, 5, 40]) + b"\n" for _ in range(60)) + b"open end"
    want, at = [], 0
    for line in data.split(b"\n")[:-1]:
        want.append((at, line))
        at += len(line) + 1
    for block in (3, 1 << 20):
        follow.BLOCK, kept = block, follow.BLOCK
        try:
            for _ in range(20):
                cuts = sorted({0, len(data), *rng.sample(range(len(data)), 6)})
                got = [x for a, b in zip(cuts, cuts[1:], strict=False) for x in follow.ended_lines(io.BytesIO(data), a, b)]
                assert got == want
        finally:
            follow.BLOCK = kept


def test_stream_follows_growing_files(spark, tmp_path):
    from tokentide.streaming import follow

    folder = tmp_path / "sessions/2026/05/10"
    folder.mkdir(parents=True)
    one, two = (folder / f"rollout-2026-05-10T00-00-00-{n}.jsonl" for n in "ab")

    def line(n, hours):
        usage = {"input_tokens": n, "output_tokens": 0, "total_tokens": n}
        return json.dumps({"type": "event_msg", "timestamp": at(hours).isoformat(), "payload": {"type": "token_count", "info": {"last_token_usage": usage}}})

    seen = []

    def start():
        events = parse.parse_lines(follow.follow(spark, str(tmp_path / "sessions")))
        records = X.line_usage(events).select("session_id", "total_tokens")
        return records.writeStream.foreachBatch(lambda df, _: seen.append(sorted((r[0], r[1]) for r in df.collect()))).option(
            "checkpointLocation", str(tmp_path / "cp")
        ).start()

    one.write_text(line(1, 1) + "\n" + line(2, 2)[:40])
    run = start()
    try:
        run.processAllAvailable()
        with open(one, "a") as f:
            f.write(line(2, 2)[40:] + "\n" + line(3, 3) + "\n")
        two.write_text(line(10, 1) + "\n")
        run.processAllAvailable()
    finally:
        run.stop()
    # A restart goes on where the last batch ended.
    with open(two, "a") as f:
        f.write(line(20, 2) + "\n")
    run = start()
    try:
        run.processAllAvailable()
    finally:
        run.stop()
    assert [x for x in seen if x] == [[("a", 1)], [("a", 2), ("a", 3), ("b", 10)], [("b", 20)]]
