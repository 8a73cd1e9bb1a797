import json
import os

import pytest
from pyspark.sql import functions as F

from tokentide import session
from tokentide.functions import scalars as S
from tokentide.functions import variants as V
from tokentide.operators import pricing
from tokentide.operators.usage import positive, usage_by, usage_totals
from tokentide.sources import ratecard, sinks

from conftest import at


def value(spark, column, **data):
    names, row = list(data), list(data.values())
    return spark.createDataFrame([row], names).select(column).first()[0]


def test_names(spark):
    assert value(spark, S.normalize_model("m"), m="  GPT-5.4   MINI ") == "gpt-5.4 mini"
    assert value(spark, S.pricing_key("m"), m="  GPT-5.4   MINI ") == "gpt-5.4-mini"
    assert value(spark, S.normalize_effort("e"), e="  X  High! ") == "x-high"
    assert value(spark, S.normalize_effort("e"), e="!!") is None
    assert value(spark, S.model_key("m", "f", "e"), m="gpt", f=True, e="Low") == "gpt-fast-low"
    assert value(spark, S.model_key("m", "f", "e"), m="unknown", f=True, e="Low") == "unknown"
    assert value(spark, S.id_part("x"), x="--A b_") == "a-b"
    assert value(spark, S.id_part("x"), x="//") == "unknown"


def test_numbers_and_times(spark):
    assert value(spark, S.percent_text("x"), x=12.50) == "12.5%"
    assert value(spark, S.percent_text("x"), x=100.0) == "100%"
    assert value(spark, S.dollars("x"), x=1234567.891) == "$1,234,567.89"
    assert value(spark, S.round_metric("x"), x=2.2500004) == 2.25
    keys = {u: value(spark, S.time_key("t", u), t=at(hours=5)) for u in ("hour", "day", "week", "month")}
    assert keys == {"hour": "2026-05-10 05:00", "day": "2026-05-10", "week": "2026-W19", "month": "2026-05"}
    assert value(spark, S.time_key("t", "day", "America/New_York"), t=at(hours=1)) == "2026-05-09"
    assert value(spark, S.iso_millis("t"), t=at()) == "2026-05-10T00:00:00.000Z"
    assert value(spark, S.range_label("t", "t"), t=at()) == "2026-05-10 00:00:00"


@pytest.mark.parametrize("text,ok", [('{"a":1}', True), ("5", True), ('{"a":1}}', False), ('{"a":1} {"b":2}', False), ('{"a":1},2', False), ("", False), ('{"a":', False), ('{"a":1}]', False)])
def test_line_is_exactly_one_value(spark, text, ok):
    assert value(spark, V.line(F.col("t")).isNotNull(), t=text) is ok


def test_tolerant_reads(spark):
    def read(fn, text):
        return value(spark, fn(V.at(V.line(F.col("t")), "$[0]")), t=text)

    assert [read(V.counter, t) for t in ("12", "12.7", "-1.5", '"12"', "true", "null", "{}")] == [12, 12, -1, None, None, None, None]
    assert [read(V.integer, t) for t in ("12", "12.0", "12.5", '" 12 "', '"1.0"')] == [12, 12, None, 12, None]
    assert [read(V.finite_number, t) for t in ("1", '" 1.5 "', '"NaN"', '"1e400"', '"x"')] == [1.0, 1.5, None, None, None]
    assert [read(V.string, t) for t in ('" a "', '"  "', "1")] == [" a ", None, None]
    assert read(V.event_time, "1778371200000").day == 10
    assert read(V.event_time, '"2026-05-10T02:00:00+02:00"').hour == 0
    assert [read(V.event_time, t) for t in ('"2026-05-10"', '"10:00"', "{}", "1e300")] == [None] * 4
    assert read(V.sample_time, "1778371200000.5") is None


def test_credits(spark, usage):
    rows = usage((at(), 0)).select(
        F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(f).alias("fast")) for m, f in
            [("gpt-5.5", False), ("gpt-5.5", True), ("gpt-5.4", True), ("mystery", True)]])).alias("x"), "*"
    ).drop("model", "fast").select("x.*", "*").withColumns(
        {"input_tokens": F.lit(1000), "cached_input_tokens": F.lit(200), "output_tokens": F.lit(300)}
    )
    got = [(float(r.credits), r.priced, r.credit_multiplier) for r in pricing.price(rows).collect()]
    assert sorted(got) == sorted([(0.3275, True, 1.0), (0.81875, True, 2.5), (0.3275, True, 2.0), (0.0, False, 1.0)])


def test_negative_and_excess_cached_tokens(spark, usage):
    row = usage((at(), 100)).withColumn("cached_input_tokens", F.lit(500)).withColumn("output_tokens", F.lit(-5))
    got = pricing.price(row).first()
    assert (got.billable_input_tokens, got.billed_cached_tokens, float(got.credits)) == (0, 100, 0.00125)


def card_file(tmp_path, **change):
    card = {
        "source": {"name": "n", "checked_at": "d", "credit_to_usd": "10 credits = $1"},
        "models": [{"key": "m", "label": "M", "input_credits_per_million": 1.0, "cached_input_credits_per_million": 0.1, "output_credits_per_million": 2.0}],
        "knownUnpriced": [{"key": "u", "label": "U"}],
    }
    card.update(change)
    path = tmp_path / "card.json"
    path.write_text(json.dumps(card))
    return str(path)


def test_rate_card(spark, tmp_path):
    card = ratecard.load(spark, card_file(tmp_path))
    assert card.credits_per_usd == 10
    assert [tuple(r)[:2] for r in pricing.inventory(card).collect()] == [("priced", "m"), ("known_unpriced", "u")]
    assert pricing.inventory(ratecard.built_in(spark)).count() == 8


@pytest.mark.parametrize("change", [
    {"models": []},
    {"source": {"name": "", "checked_at": "d", "credit_to_usd": "10 credits = $1"}},
    {"source": {"name": "n", "checked_at": "d", "credit_to_usd": "10 coins"}},
    {"knownUnpriced": [{"key": "m", "label": "M"}]},
    {"models": [{"key": "m", "label": "M", "input_credits_per_million": -1.0, "cached_input_credits_per_million": 0.1, "output_credits_per_million": 2.0}]},
    {"models": [{"key": "m", "label": "M", "input_credits_per_million": 1.0, "cached_input_credits_per_million": 0.1, "output_credits_per_million": 2.0}] * 2},
])
def test_bad_rate_cards(spark, tmp_path, change):
    with pytest.raises(ValueError):
        ratecard.load(spark, card_file(tmp_path, **change))


def test_unpriced_stub_and_limits(spark, usage):
    got = pricing.unpriced_models(pricing.price(usage((at(), 5, {"model": 'My "X"'}), (at(), 7, {"model": 'my  "x"'})))).first()
    assert (got.pricing_key, got.model, got.calls, got.total_tokens) == ('my "x"', 'My "X"', 2, 12)
    assert '"label": "My \\"X\\""' in got.pricing_stub
    for bad in (0, -1, True, "3"):
        with pytest.raises(ValueError):
            positive(bad)


def test_sinks(spark, tmp_path, usage):
    priced = pricing.price(usage((at(), 10), (at(), 20, {"cwd": 'a,"b"'})))
    rows, totals = usage_by(priced, "cwd"), usage_totals(priced, "cwd")
    sinks.write_csv(rows, str(tmp_path / "csv"), totals)
    text = [line for f in sorted((tmp_path / "csv").glob("part*")) for line in f.read_text().splitlines()]
    assert text[0].startswith("key,sessions,calls") and any(line.startswith('"a,""b""",') for line in text)
    assert text[-1].startswith("Total,1,2,30") and len(text) == 4 and sum(line.startswith("key,") for line in text) == 1
    sinks.write_json(rows, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    report = json.loads("".join(r.text for r in sinks.report_json(rows, totals, groupBy="cwd").collect()))
    assert [r["key"] for r in report["rows"]] == ["/w", 'a,"b"'] and report["totals"]["calls"] == 2
    many = spark.range(120_000).select("id")
    sinks.write_report(many, str(tmp_path / "many"), title="x")
    whole = "".join(f.read_text() for f in sorted((tmp_path / "many").glob("part*")))
    assert json.loads(whole) == {"title": "x", "rows": [{"id": k} for k in range(120_000)]}
    assert json.loads("".join(r.text for r in sinks.report_json(many.limit(0)).collect())) == {"rows": []}


def test_staged_tables_are_deleted(spark, monkeypatch):
    monkeypatch.setattr(session, "checkpoint_dir", lambda _: session._own_folder())
    folder = session.staging_folder(spark)
    one, two = session.stage(spark.range(5)), session.stage(spark.range(7))
    assert one.count() == 5 and os.path.isdir(one.staged_at)
    session.unstage(one)
    assert not os.path.exists(one.staged_at) and two.count() == 7
    with session.staging(spark):
        assert session.stage(spark.range(3)).count() == 3
    assert not os.path.exists(folder)


def test_rates_must_fit(spark, tmp_path):
    card = {
        "source": {"name": "n", "checked_at": "2026-01-01", "credit_to_usd": "30 credits = $1"},
        "models": [{"key": "m", "label": "M", "input_credits_per_million": 1.00125, "cached_input_credits_per_million": 0.00125,
                    "output_credits_per_million": 3.0, "fast_credit_multiplier": 1.3333}],
        "knownUnpriced": [],
    }
    path = tmp_path / "card.json"
    path.write_text(json.dumps(card))
    got = ratecard.load(spark, str(path)).models.first()
    assert (str(got.in_rate), str(got.cached_rate), str(got.fast_mult)) == ("1.001250", "0.001250", "1.333300")
    for field, value in (("output_credits_per_million", 0.0000001), ("fast_credit_multiplier", 5000.0)):
        bad = {**card, "models": [{**card["models"][0], field: value}]}
        path.write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            ratecard.load(spark, str(path))


def test_variant_reads_are_not_repeated(spark):
    """A read that tests its value several times makes it once."""
    one = spark.createDataFrame([('"-1.5"',)], "t string").select(F.parse_json("t").alias("v"))
    for read, want in ((V.finite_number, -1.5), (V.integer, None), (V.seconds_time, None), (V.string, "-1.5")):
        df = one.select(read(F.col("v")).alias("x"))
        assert df.first().x == want
        assert df._jdf.queryExecution().analyzed().toString().count("try_variant_get") <= 3
