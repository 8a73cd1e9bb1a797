"""Format-preserving pseudonyms of validated numbers, dates and addresses, by a keyed Feistel network in SQL expressions.

A value is taken apart into small digits with a radix each, cut into two halves, and in each of `ROUNDS` rounds one half is
shifted digit by digit by a keyed hash of the other. Whatever the key, this permutes all values of one format, so equal
values get equal pseudonyms in all documents, different values get different ones, and the key's holder can undo it
(`restore`). What is replaced:

* payment cards (13 to 19 digits, Luhn sum valid): all digits but the first; the check digit is made anew;
* IBANs (check digits valid): letters and digits after the country code, check digits made anew;
* telephone numbers: ten digits after +1, with a bracketed area code, or of the North American plan keep the leading digits of area
  and exchange, so a number has one pseudonym however it is written; +country numbers keep their first three;
* IPv4 addresses: as four bytes;
* social security numbers of a valid area, group and serial: as those three numbers;
* calendar dates from 1900 to 2099: year first, or year last after day and month (with slashes month and day, unless the first is
  above 12): year and day of the year; 29 February moves among leap years. A number written without leading
  zero may become one of two digits, so `restore` gives the date back, with a zero before a single digit at times;
* e-mail addresses: letters and digits before the @ sign;
* keys of 32 to 64 hexadecimal digits in one case; both cases of a key get one pseudonym, each in its case. (A key in upper case whose
  pseudonym has no letter, about one in three million of the shortest, comes back in lower case.)

Numbers that fail validation stay. Defined cases: a null text stays null with nothing replaced; an empty one stays empty; every other
column is passed on; repeated rows get equal texts; an empty table gives an empty result. The derived key is part of the
query plan, so plans and event logs must be kept like the key.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

# A country code and groups of digits. The first and third form look ahead, so that a run of more than 15 digits is not taken whole.
_SHORT_RUN = r"(?=\+(?:[ .-]?[0-9]){8,15}(?![ .-]?[0-9]))"
_ABROAD = (
    _SHORT_RUN + r"\+[2-9][0-9]{0,2}(?:[ -][0-9]{1,4}){3,6}|\+[2-9][0-9]{0,2}[ .-]?[0-9](?:[ .-][0-9]{2}){4}"
    r"|" + _SHORT_RUN + r"\+[2-9][0-9]{0,2}[ .-]?[0-9]{1,4}(?:[ .-]?[0-9]{2,4}){2,5}"
    r"|\+[2-9][0-9]{0,2}[ .-]?[0-9]{1,4}(?:[ .-]?[0-9]{2,4}){2}"
)
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?|[A-Z0-9]{11,30})(?![0-9A-Za-z])",
    "phone": r"(?<![0-9+])(?:\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}|" + _ABROAD + r"|\([0-9]{3}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}"
    r"|\(?[2-9][0-9]{2}\)?[ .-][2-9][0-9]{2}[ .-][0-9]{4})(?![0-9])",
    "date": r"(?<![0-9.-])(?:[0-9]{4}([-/.])[0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{4})(?![0-9]|[-.][0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9])(?:(?:[0-9]{4}[ -]){3}[0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{13,19})(?![0-9])",
}
ANY = "|".join(PATTERNS[k] for k in ("email", "secret", "iban", "phone", "date", "ssn", "ip", "card"))
# Days of a common year before each month.
_BEFORE = "array(0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334)"


def _let(name: str, value: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _chars(text: str) -> str:
    return f"transform(sequence(1, length({text})), at_ -> substr({text}, at_, 1))"


class Network:
    """SQL text of the permutation under one key; `back` inverts it."""

    def __init__(self, key: str, back: bool = False):
        self.key = hashlib.sha256(key.encode()).hexdigest()
        self.back = back

    def _shift(self, kind: str, other: str) -> str:
        bound = f"concat_ws('|', '{self.key}', '{kind}', cast(turn as string), cast(i as string), concat_ws(',', transform({other}, y -> cast(y as string))))"
        return f"cast(conv(substr(sha2({bound}, 256), 1, 8), 16, 10) as bigint)"

    def digits(self, values: str, radix: str, kind: str) -> str:
        """Permuted digits: `values[i]` stays below `radix[i]`. The first half has size div 2 digits."""
        half = "size(v) div 2"
        begin = (
            f"named_struct('a', slice(v, 1, {half}), 'ra', slice(w, 1, {half}), "
            f"'b', slice(v, {half} + 1, size(v) - {half}), 'rb', slice(w, {half} + 1, size(w) - {half}))"
        )
        if not self.back:
            moved = f"transform(s.a, (x, i) -> cast(pmod(x + {self._shift(kind, 's.b')}, element_at(s.ra, i + 1)) as int))"
            step = f"named_struct('a', s.b, 'ra', s.rb, 'b', {moved}, 'rb', s.ra)"
            turns = f"sequence(0, {ROUNDS - 1})"
        else:
            moved = f"transform(s.b, (x, i) -> cast(pmod(x - {self._shift(kind, 's.a')}, element_at(s.rb, i + 1)) as int))"
            step = f"named_struct('a', {moved}, 'ra', s.rb, 'b', s.a, 'rb', s.ra)"
            turns = f"sequence({ROUNDS - 1}, 0, -1)"
        run = f"aggregate({turns}, {begin}, (s, turn) -> {step}, s -> concat(s.a, s.b))"
        return _let("v", values, _let("w", radix, run))

    def characters(self, text: str, free: str, kind: str, hexadecimal: bool = False) -> str:
        """`text` with the characters at the places `free` permuted, each within its class."""
        ch = f"substr({text}, p, 1)"
        if hexadecimal:
            value, radix = f"instr('0123456789abcdef', {ch}) - 1", "16"
            made = "substr('0123456789abcdef', n + 1, 1)"
        else:
            value = f"case when {ch} between '0' and '9' then ascii({ch}) - 48 when {ch} between 'a' and 'z' then ascii({ch}) - 97 else ascii({ch}) - 65 end"
            radix = f"if({ch} between '0' and '9', 10, 26)"
            made = f"case when {ch} between '0' and '9' then char(n + 48) when {ch} between 'a' and 'z' then char(n + 97) else char(n + 65) end"
        values, radixes = f"transform(f, p -> {value})", f"transform(f, p -> {radix})"
        place = "cast(array_position(f, p) as int)"
        put = f"if({place} > 0, {_let('n', f'element_at(o, {place})', made)}, {ch})"
        whole = f"array_join(transform(sequence(1, length({text})), p -> {put}), '')"
        changed = _let("o", self.digits(values, radixes, kind), whole)
        return _let("f", free, f"if(size(f) = 0, {text}, {changed})")

    # Each kind: (is it valid?, its replacement), as SQL over the match `m`.

    def card(self) -> tuple[str, str]:
        number = "regexp_replace(m, '[^0-9]', '')"
        doubled = "if(i % 2 = 0, if(cast(d as int) > 4, 2 * cast(d as int) - 9, 2 * cast(d as int)), cast(d as int))"

        def check(digits: str) -> str:
            body = f"reverse(slice({_chars(digits)}, 1, length({digits}) - 1))"
            total = f"aggregate(transform({body}, (d, i) -> {doubled}), 0, (x, y) -> x + y)"
            return f"cast((10 - {total} % 10) % 10 as string)"

        free = self._digit_places()
        inner = "slice(g, 2, size(g) - 2)"
        moved = _let("g", free, self.characters("m", inner, "card"))
        sealed = _let(
            "moved", moved, f"concat(substr(moved, 1, length(moved) - 1), {_let('num', number.replace('(m,', '(moved,'), check('num'))})"
        )
        valid = _let("num", number, f"length(num) between 13 and 19 and substr(num, -1, 1) = {check('num')}")
        return valid, sealed

    @staticmethod
    def _digit_places() -> str:
        return "filter(sequence(1, length(m)), p -> substr(m, p, 1) between '0' and '9')"

    def iban(self) -> tuple[str, str]:
        def rest(text: str, check: str) -> str:
            order = f"concat(substr({text}, 5), substr({text}, 1, 2), {check})"
            step = "(case when c between '0' and '9' then acc * 10 + ascii(c) - 48 else acc * 100 + ascii(c) - 55 end) % 97"
            return _let("line", order, f"aggregate({_chars('line')}, 0, (acc, c) -> {step})")

        bare = "replace(m, ' ', '')"
        valid = _let("t", bare, f"length(t) between 15 and 34 and {rest('t', 'substr(t, 3, 2)')} = 1")
        free = "filter(sequence(5, length(m)), p -> substr(m, p, 1) <> ' ')"
        digits = _let("t", "replace(moved, ' ', '')", f"lpad(cast(98 - {rest('t', chr(39) + '00' + chr(39))} as string), 2, '0')")
        sealed = _let("moved", self.characters("m", free, "iban"), f"concat(substr(moved, 1, 2), {digits}, substr(moved, 5))")
        return valid, sealed

    def phone(self) -> tuple[str, str]:
        ten = "if(startswith(m, '+1'), slice(g, 2, 10), g)"
        plan = "(startswith(m, '+1') or not startswith(m, '+'))"
        free = f"if({plan}, {_let('t', ten, 'concat(slice(t, 2, 2), slice(t, 5, 6))')}, slice(g, 4, size(g)))"
        valid = _let("g", self._digit_places(), f"if({plan}, size(g) = 10 + if(startswith(m, '+1'), 1, 0), size(g) between 8 and 15)")
        return valid, _let("g", self._digit_places(), self.characters("m", free, "phone"))

    def ip(self) -> tuple[str, str]:
        parts = "split(m, '[.]')"
        valid = f"forall({parts}, x -> cast(x as int) <= 255 and (x = '0' or not startswith(x, '0')))"
        moved = self.digits(f"transform({parts}, x -> cast(x as int))", "array(256, 256, 256, 256)", "ip")
        return valid, f"array_join(transform({moved}, x -> cast(x as string)), '.')"

    def ssn(self) -> tuple[str, str]:
        n = "transform(split(m, '-'), x -> cast(x as int))"
        valid = _let("n", n, "element_at(n, 1) between 1 and 899 and element_at(n, 1) <> 666 and element_at(n, 2) > 0 and element_at(n, 3) > 0")
        values = _let("n", n, "array(element_at(n, 1) - 1 - if(element_at(n, 1) > 666, 1, 0), element_at(n, 2) - 1, element_at(n, 3) - 1)")
        area = "element_at(q, 1) + 1 + if(element_at(q, 1) >= 665, 1, 0)"
        made = (
            f"concat(lpad(cast({area} as string), 3, '0'), '-', lpad(cast(element_at(q, 2) + 1 as string), 2, '0'), '-', "
            "lpad(cast(element_at(q, 3) + 1 as string), 4, '0'))"
        )
        return valid, _let("q", self.digits(values, "array(898, 99, 9999)", "ssn"), made)

    def date(self) -> tuple[str, str]:
        first = "length(element_at(t, 1)) = 4"
        late = f"(not {first} and contains(m, '/') and cast(element_at(t, 1) as int) > 12)"
        year = f"cast(if({first}, element_at(t, 1), element_at(t, 3)) as int)"
        swap = f"(not contains(m, '/') or {late})"
        month_at = f"case when {first} then 2 when {swap} then 2 else 1 end"
        day_at = f"case when {first} then 3 when {swap} then 1 else 2 end"
        parsed = (
            f"named_struct('t', t, 'late', {late}, 'y', {year}, 'mp', {month_at}, 'dp', {day_at}, "
            f"'mo', cast(element_at(t, {month_at}) as int), 'da', cast(element_at(t, {day_at}) as int))"
        )
        fields = _let("t", "split(m, '[-/.]')", parsed)
        one_mark = "regexp_replace(m, '[0-9]', '') in ('--', '//', '..')"
        last = "day(last_day(make_date(k.y, k.mo, 1)))"
        valid = f"{one_mark} and " + _let(
            "k", fields, f"case when k.y between 1900 and 2099 and k.mo between 1 and 12 then k.da between 1 and {last} else false end"
        )
        leap = "k.mo = 2 and k.da = 29"
        common = self.digits(f"array(k.y - 1900, element_at({_BEFORE}, k.mo) + k.da - 1)", "array(200, 365)", "date")
        leaps = self.digits("array(cast((k.y - 1904) div 4 as int))", "array(49)", "leap")
        month = f"size(filter({_BEFORE}, c -> c <= element_at(q, 2)))"
        fresh = _let(
            "q", common, f"named_struct('y', element_at(q, 1) + 1900, 'mo', {month}, 'da', element_at(q, 2) - element_at({_BEFORE}, {month}) + 1)"
        )
        moved_leap = _let("q", leaps, "named_struct('y', 4 * element_at(q, 1) + 1904, 'mo', 2, 'da', 29)")
        # A day above 12 that comes first must stay above 12, or it would read as a month.
        inside = self.digits("array(k.y - 1900, k.mo - 1, k.da - 13)", "array(200, 12, 16)", "inside")
        ends = self.digits("array(k.y - 1900)", "array(200)", "ends")
        moved_inside = _let("q", inside, "named_struct('y', element_at(q, 1) + 1900, 'mo', element_at(q, 2) + 1, 'da', element_at(q, 3) + 13)")
        moved_ends = _let("q", ends, "named_struct('y', element_at(q, 1) + 1900, 'mo', k.mo, 'da', k.da)")
        made = f"case when {leap} then {moved_leap} when not k.late then {fresh} when k.da <= 28 then {moved_inside} else {moved_ends} end"
        piece = (
            "case when i + 1 = k.mp then lpad(cast(z.mo as string), greatest(length(x), length(cast(z.mo as string))), '0') "
            "when i + 1 = k.dp then lpad(cast(z.da as string), greatest(length(x), length(cast(z.da as string))), '0') "
            "else cast(z.y as string) end"
        )
        written = f"array_join(transform(k.t, (x, i) -> {piece}), substr(regexp_replace(m, '[0-9]', ''), 1, 1))"
        return valid, _let("k", fields, _let("z", made, written))

    def email(self) -> tuple[str, str]:
        free = "filter(sequence(1, instr(m, '@') - 1), p -> substr(m, p, 1) rlike '[0-9A-Za-z]')"
        return "instr(m, '@') > 1", self.characters("m", free, "email")

    def secret(self) -> tuple[str, str]:
        moved = _let("low", "lower(m)", self.characters("low", "sequence(1, length(low))", "secret", hexadecimal=True))
        return "true", _let("x", moved, "if(m rlike '[A-F]', upper(x), x)")

    def replacement(self) -> str:
        """Lambda over a match: what to write in its place, and whether it was valid."""
        cases = []
        for kind in PATTERNS:
            valid, made = getattr(self, kind)()
            shape = PATTERNS[kind].replace("\\", "\\\\").replace("'", "\\'")
            cases.append(f"when m rlike '^(?:{shape})$' and ({valid}) then named_struct('made', {made}, 'valid', true)")
        return f"m -> case {' '.join(cases)} else named_struct('made', m, 'valid', false) end"


def replaced(docs: DataFrame, key: str, text_col: str = "text", count_col: str = "n_replaced", back: bool = False) -> DataFrame:
    """The table with pseudonyms in its text and their number as a further column; all other columns stay."""
    text = F.col(f"`{text_col}`")
    found = docs.select("*", F.struct(F.coalesce(F.expr(f"size({_matches(text_col)})"), F.lit(0)).alias("any")).alias("_pseudonym_"))
    new = F.expr(f"transform({_matches(text_col)}, {Network(key, back).replacement()})")
    pieces = F.split(text, ANY, -1)
    put = F.struct(pieces.alias("pieces"), new.alias("new"))
    found = found.withColumn("_pseudonym_", F.when(F.col("_pseudonym_.any") > 0, put))
    made = F.transform(F.col("_pseudonym_.new"), lambda x: x["made"])
    joined = F.array_join(F.zip_with(F.col("_pseudonym_.pieces"), F.concat(made, F.array(F.lit(""))), lambda p, n: F.concat(p, n)), "")
    valid: Column = F.size(F.filter(F.col("_pseudonym_.new"), lambda x: x["valid"]))
    whole = F.when(F.col("_pseudonym_").isNotNull(), joined).otherwise(text)
    count = F.when(F.col("_pseudonym_").isNotNull(), valid).otherwise(F.lit(0))
    others = [F.col(f"`{c}`") for c in docs.columns]
    return found.select(
        *[whole.alias(c) if c == text_col else o for c, o in zip(docs.columns, others, strict=True)], count.cast("int").alias(count_col)
    )


def restore(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """Undo `replaced` under the same key."""
    return replaced(docs, key, text_col, "n_restored", back=True)


def _matches(text_col: str) -> str:
    shape = ANY.replace("\\", "\\\\").replace("'", "\\'")
    return f"regexp_extract_all(`{text_col}`, '{shape}', 0)"
