import hashlib
import re

from tokentide.llm import pseudonyms

KEY = "test key"


def shift(kind, turn, i, other):
    bound = "|".join([hashlib.sha256(KEY.encode()).hexdigest(), kind, str(turn), str(i), ",".join(map(str, other))])
    return int(hashlib.sha256(bound.encode()).hexdigest()[:8], 16)


def network(values, radix, kind):
    h = len(values) // 2
    a, b, ra, rb = values[:h], values[h:], radix[:h], radix[h:]
    for turn in range(pseudonyms.ROUNDS):
        a, b, ra, rb = b, [(x + shift(kind, turn, i, b)) % r for i, (x, r) in enumerate(zip(a, ra, strict=True))], rb, ra
    return a + b


def luhn(digits):
    total = sum(d if k % 2 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(reversed(digits)))
    return (10 - total % 10) % 10


def texts(spark, rows, act=pseudonyms.replaced):
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    return [r.text for r in sorted(act(df, KEY).collect(), key=lambda r: r.doc_id)]


CASES = [
    "call +1 (988) 555-2485 or (269) 555-3296 now.",
    "card 4041894974608795 and 4041 8949 7460 8795, once more 4041894974608795",
    "ip 70.123.182.155. and 8.8.8.8, not 300.1.1.1 nor 1.2.3.4.5",
    "GB82WEST12345698765432 GB82 WEST 1234 5698 7654 32 end",
    "born 1984-02-29, 2023-01-05; 31.12.1999 12/31/1999 31/12/1999 25/12/1999 29/02/2000",
    "ssn 123-45-6789 but 000-12-1234 666-11-1111",
    'a.b42@mail8.example.com token = "0641917ea4e9feb9cda83477b57ac2654884f485"',
    "+44 20 7946 0958",
]


def test_against_brute_force(spark):
    digits = [int(c) for c in "4041894974608795"]
    inner = network(digits[1:-1], [10] * 14, "card")
    card = digits[:1] + inner
    card = "".join(map(str, [*card, luhn(card)]))
    ip = ".".join(map(str, network([70, 123, 182, 155], [256] * 4, "ip")))
    mail = "ab42"
    moved = network([0, 1, 4, 2], [26, 26, 10, 10], "email")
    mail = f"{chr(97 + moved[0])}.{chr(97 + moved[1])}{moved[2]}{moved[3]}@mail8.example.com"
    day = network([2023 - 1900, 4], [200, 365], "date")
    got = texts(spark, ["4041894974608795", "x 70.123.182.155.", "a.b42@mail8.example.com", "2023-01-05"])
    assert got[:3] == [card, f"x {ip}.", mail]
    assert got[3].startswith(str(1900 + day[0]))


def test_formats_stay_valid_and_are_undone(spark):
    out = texts(spark, CASES)
    assert all(a != b and len(re.sub(r"\d+", "", a)) == len(re.sub(r"\d+", "", b)) for a, b in zip(CASES[:1] + CASES[2:3], out[:1] + out[2:3], strict=True))
    cards = re.findall(r"\d{16}", out[1])
    assert cards[0] == cards[1] and cards[0] in out[1].replace(" ", "").replace("card", "") and luhn([int(c) for c in cards[0][:-1]]) == int(cards[0][-1])
    assert "300.1.1.1" in out[2] and "1.2.3.4.5" in out[2] and "000-12-1234 666-11-1111" in out[5]
    ibans = re.findall(r"GB[0-9A-Z]{20}", out[3].replace("GB", " GB"))
    bare = ibans[0][4:] + ibans[0][:4]
    assert int("".join(str(int(c, 36)) for c in bare)) % 97 == 1
    assert texts(spark, out, pseudonyms.restore) == CASES


def test_a_permutation(spark):
    rows = [f"10.0.{a}.{b}" for a in range(0, 250, 5) for b in range(0, 250, 10)] + [f"{y}-03-{d:02d}" for y in range(1990, 2020) for d in range(1, 29)]
    out = texts(spark, rows)
    assert len(set(out)) == len(rows)
    assert texts(spark, out, pseudonyms.restore) == rows
    days = [f"{d}/{m:02d}/2001" for m in range(1, 13) for d in range(13, 29)]
    moved = texts(spark, days)
    assert len(set(moved)) == len(days) and texts(spark, moved, pseudonyms.restore) == days


def test_numbers_outside_the_plan_short_groups_and_upper_case(spark):
    key = "9233a8ecf70641917ea4e9feb9cda834"
    spans = ["+1 (017) 555-7713", "+1 (045) 555-3286", "+1 212 155-0001", "(017) 555-7713", "(212) 155-0001", "+33 1 23 45 67 89", "+33.1.23.45.67.89"]
    spans += ["+55 11 9 1234 5678", "+61 2 9374 4000", key.upper(), key]
    rows = [f"x {v}, y" for v in spans] + ["+44 20 7946 0958 4041 8949 7460 8795", "+2.50 3.75 1.25 and +3 4 5", "017 555-7713"]
    out = texts(spark, rows)
    shape = [re.sub("[0-9]", "0", t) for t in rows[:9]]
    assert [re.sub("[0-9]", "0", t) for t in out[:9]] == shape and all(a != b for a, b in zip(rows[:11], out, strict=False))
    assert out[0][5:] == out[3][2:] and out[9] == out[10].upper().replace("X", "x").replace("Y", "y")
    assert "20 7946 0958" not in out[11] and "4041 8949 7460 8795" not in out[11]
    assert out[12:] == rows[12:]
    assert texts(spark, out, pseudonyms.restore) == rows
    a_permutation = [f"+1 ({a:03d}) {e}55-7713" for a in range(1000) for e in (0, 5)]
    moved = texts(spark, a_permutation)
    assert len(set(moved)) == 2000 and texts(spark, moved, pseudonyms.restore) == a_permutation


def test_nothing_else_changes(docs, corpus):
    out = pseudonyms.replaced(docs, KEY)
    assert out.columns == [*docs.columns, "n_replaced"]
    assert {(r.doc_id, r.text, r.n_replaced) for r in out.collect()} == {(i, t, 0) for i, t, _ in corpus}


def test_edge_tables(no_docs, null_rows, spark):
    assert pseudonyms.replaced(no_docs, KEY).collect() == []
    assert [r.n_replaced for r in pseudonyms.replaced(null_rows, KEY).collect()] == [0] * 6
    long = "x " * 200_000 + "70.123.182.155 " * 2000
    assert texts(spark, [long, None, ""])[1:] == [None, ""]
