"""Personal data: patterns propose spans, checksums confirm them, context adjusts a score.

Every span is (start, end, kind, score), in code points, end exclusive. The base kinds
are email, ip, card and phone; iban and ssn are added where their score reaches
`ADDED_MIN`. All of it is column expressions on one row: no shuffle, no Python.

The patterns are written so that a run of characters is read once (possessive
quantifiers, and a look behind that starts only at the beginning of a run or where the
last match ended), so a text of millions of characters without a match stays linear;
so does one of very many matches, whose places are sums over pieces of an array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalog.llm.common import let

# Kinds in their order, patterns, words that stand near such data.
KINDS = ["email", "ip", "card", "phone", "iban", "ssn"]
BASE_KINDS = KINDS[:4]

PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}
# Letters and digits of an IBAN by country; codes that are not listed keep the general form.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban() -> str:
    """An IBAN ends where its country says, so that it takes nothing of the next word."""
    forms, codes = [], []
    for n, names in IBAN_LENGTHS.items():
        codes += names.split()
        groups, rest = divmod(n - 4, 4)
        tail = f" ?[A-Z0-9]{{{rest}}}" if rest else ""
        forms.append(f"(?:{'|'.join(names.split())})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{groups}}}{tail}")
    edge = "(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2})"
    known = f"{edge}(?:{'|'.join(forms)})(?![A-Za-z0-9])"
    other = f"(?!{'|'.join(codes)})[A-Z]{{2}}[0-9]{{2}}(?: ?(?!{known})[A-Z0-9]{{4}}){{2,7}}(?: ?(?!{known})[A-Z0-9]{{1,3}})?"
    return f"{known}|{edge}{other}"


# What is looked for; all but the IBAN as the pattern says.
FORMS = PATTERNS | {"iban": _iban()}

# A text without this has no match of the kind.
HINTS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}

CONTEXT = {
    "email": "mail|contact|write to|kontakt|correo|courriel",
    "ip": "ip|address|host|server|adresse",
    "card": "card|credit|visa|amex|payment|karte|tarjeta|carte",
    "phone": "phone|call|tel|mobile|fax|anruf|llame|appel",
    "iban": "iban|account|bank|konto|cuenta|compte|transfer",
    "ssn": "ssn|social security|social-security|tax id",
}
CONTEXT_CHARS = 40
# Between the numbers of a list, which share their context.
LIST_GAP = r"^[^A-Za-z0-9.!?]{1,8}(?:(?:and|or|und|oder|et|ou|y|o)[^A-Za-z0-9.!?]{1,4})?$"
PRIOR = {"email": 80, "ip": 60, "card": 70, "phone": 50, "iban": 70, "ssn": 30}
CONTEXT_BONUS = 20
ADDED_MIN = 50


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, n + 1 - i, F.lit(1)).cast("int")
        doubled = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _mod97(value: Column) -> Column:
    compact = F.replace(value, F.lit(" "), F.lit(""))
    moved = F.concat(F.substr(compact, F.lit(5)), F.substr(compact, F.lit(1), F.lit(4)))

    def step(rest: Column, c: Column) -> Column:
        letter = c >= "A"
        number = F.when(letter, F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
        return (rest * F.when(letter, F.lit(100)).otherwise(F.lit(10)) + number) % 97

    return F.aggregate(F.split(moved, ""), F.lit(0), lambda r, c: F.when(c == "", r).otherwise(step(r, c))) == 1


def _alone(before: Column, after: Column, chars: str) -> Column:
    return ~before.rlike(chars) & ~after.rlike(chars)


def _valid(kind: str, value: Column, before: Column, after: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        return F.when(_alone(before, after, "[A-Za-z0-9]"), _mod97(value)).otherwise(F.lit(False))
    if kind == "ssn":
        return _alone(before, after, "[0-9-]")
    return F.lit(True)


# Values that are summed up in one go, and characters of a text that are cut out in one go.
PIECE = 256
TEXT_BLOCK = 1024

SPAN = "struct<start:int,rank:int,end:int,kind:string,score:int>"


def _scan(values: Column, op, out: str) -> Column:
    """For each value, `op` over the ones before it, from 0."""

    def step(acc: Column, x: Column) -> Column:
        return F.struct(op(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast(out).alias("out"))
    return F.aggregate(values, begin, step, lambda a: a["out"])


def _before(values: Column, op) -> Column:
    """`_scan` of an array that is not empty, by pieces of `PIECE`: one growing array of
    all results would be copied for every value."""
    pieces = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(values) - 1) / PIECE).cast("int")),
        lambda k: F.slice(values, k * PIECE + 1, F.lit(PIECE)),
    )

    def join(p: Column) -> Column:
        tops = F.transform(p, lambda one: F.aggregate(one, F.lit(0), op))
        return F.flatten(
            F.zip_with(
                p,
                _scan(tops, op, "array<int>"),
                lambda one, top: F.transform(_scan(one, op, "array<int>"), lambda x: op(top, x)),
            )
        )

    return let(pieces, join)


def _near_in_lists(own: Column, listed: Column) -> Column:
    """'1' or '0' per match: context next to it or to any number of its list.

    A letter per match says whether a list goes on there (c, d) and whether it has context
    itself (b, d); a pattern then finds the lists."""
    letters = F.zip_with(
        own,
        listed,
        lambda n, l: F.when(l, F.when(n, F.lit("d")).otherwise(F.lit("c"))).otherwise(
            F.when(n, F.lit("b")).otherwise(F.lit("a"))
        ),
    )
    lists = F.regexp_extract_all(F.array_join(letters, ""), F.lit("[ab][cd]*+"), F.lit(0))
    marks = F.transform(
        lists, lambda one: F.repeat(F.when(one.rlike("[bd]"), F.lit("1")).otherwise(F.lit("0")), F.length(one))
    )
    return F.split(F.array_join(marks, ""), "")


def _spans_of(text: Column, kind: str) -> Column:
    """Valid matches of one kind, in order. The pieces between the matches give their
    places: a match starts after all pieces and matches before it. Time and memory grow
    with the number of matches, not its square.

    An added kind takes its context from the text on both sides, over other matches, and
    from its neighbours in a list of numbers."""
    pattern = FORMS[kind]
    added = kind not in BASE_KINDS
    cut = F.struct(
        F.split(text, pattern, -1).alias("pieces"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"),
    )
    none = F.array().cast(f"array<{SPAN}>")

    def collect(c: Column) -> Column:
        n = F.size(c["matches"])
        places = F.sequence(F.lit(0), n - 1)
        nothing = F.lit("")

        def match(i: Column) -> Column:
            return F.coalesce(F.get(c["matches"], i), nothing)

        def piece(i: Column) -> Column:
            return F.coalesce(F.get(c["pieces"], i), nothing)

        def near(i: Column) -> Column:
            """Context words beside the match itself. No match is shorter than 11, so 40
            characters reach over three others and into a fourth."""
            ahead = F.right(piece(i), F.lit(CONTEXT_CHARS))
            if not added:
                return F.lower(ahead).rlike(CONTEXT[kind])
            parts = [ahead]
            for k in (1, 2, 3, 4):
                parts = [F.right(piece(i - k), F.lit(CONTEXT_CHARS)), F.right(match(i - k), F.lit(CONTEXT_CHARS)), *parts]
            ahead = F.right(F.concat(*parts), F.lit(CONTEXT_CHARS))
            parts = [piece(i + 1)]
            for k in (1, 2, 3):
                parts += [match(i + k), piece(i + k + 1)]
            behind = F.left(F.concat(*[F.left(x, F.lit(CONTEXT_CHARS)) for x in parts]), F.lit(CONTEXT_CHARS))
            return F.lower(ahead).rlike(CONTEXT[kind]) | F.lower(behind).rlike(CONTEXT[kind])

        def good(i: Column) -> Column:
            # Between two matches without a piece stands the other match's own character.
            before = F.when((piece(i) == "") & (i > 0), F.lit("0")).otherwise(F.right(piece(i), F.lit(1)))
            after = F.when((piece(i + 1) == "") & (i < n - 1), F.lit("0")).otherwise(F.left(piece(i + 1), F.lit(1)))
            return _valid(kind, match(i), before, after)

        lengths = F.transform(places, lambda i: F.length(piece(i)) + F.length(match(i)))
        ends = let(lengths, lambda x: _before(x, lambda a, b: a + b))
        if added:
            listed = F.transform(places, lambda i: (i > 0) & piece(i).rlike(LIST_GAP))
            nears = _near_in_lists(F.transform(places, near), listed)
        else:
            nears = F.transform(places, lambda i: F.when(near(i), F.lit("1")).otherwise(F.lit("0")))

        def build(s: Column) -> Column:
            def span(i: Column) -> Column:
                start = F.get(s["ends"], i) + F.length(piece(i))
                bonus = F.when(F.get(s["nears"], i) == "1", F.lit(CONTEXT_BONUS)).otherwise(F.lit(0))
                return F.struct(
                    start.alias("start"),
                    F.lit(KINDS.index(kind)).alias("rank"),
                    (start + F.length(match(i))).alias("end"),
                    F.lit(kind).alias("kind"),
                    (F.lit(PRIOR[kind]) + bonus).alias("score"),
                )

            found = F.transform(F.filter(places, good), span)
            return F.filter(found, lambda x: x["score"] >= ADDED_MIN) if added else found

        return let(F.struct(ends.alias("ends"), nears.alias("nears")), build)

    may = F.contains(text, F.lit(HINTS[kind])) if kind in HINTS else F.lit(True)
    return F.when(may & text.rlike(pattern), let(cut, collect)).otherwise(none)


def spans(text: Column) -> Column:
    """All spans of a text by start, then kind as listed; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    return F.array_sort(F.concat(*[_spans_of(text, k) for k in KINDS]))


def find_pii(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """`docs` with `pii`, its spans. Rows stay as they are, repeated ones too; a null or
    empty text has none. A clashing column `pii` is replaced."""
    return docs.withColumn("pii", spans(F.col(text_column)))


def _written(found: Column) -> Column:
    return F.array_join(
        F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def _count(kind: str) -> Column:
    return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long")


def pii_report(docs: DataFrame) -> DataFrame:
    """doc_id, spans of each base kind counted, the digest of the base spans, all spans."""
    found = find_pii(docs.select("doc_id", "text"))
    base = F.filter("pii", lambda s: s["rank"] < len(BASE_KINDS))
    counts = [_count(k).alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", "pii").select(
        "doc_id",
        *counts,
        F.sha2(_written(base), 256).alias("base_sha256"),
        _written(F.col("pii")).alias("spans"),
        F.array_join(F.transform("pii", lambda s: s["score"].cast("string")), ",").alias("scores"),
    )


def redact(docs: DataFrame, min_score: int = ADDED_MIN) -> DataFrame:
    """`docs` with every span of at least `min_score` replaced by its kind in brackets,
    and `n_chars`, where there is one, counted anew. Of overlapping spans the first,
    then the earlier kind, is named, and all of their characters go. Null texts stay."""
    kept = F.filter(spans(F.col("text")), lambda s: s["score"] >= min_score)

    def write(c: Column) -> Column:
        def between(start: Column, end: Column) -> Column:
            """Characters of the text, from the blocks they lie in: a substring of the whole
            text would count its characters from the first one again."""
            first = F.floor(start / TEXT_BLOCK).cast("int")
            count = F.floor(end / TEXT_BLOCK).cast("int") - first + 1
            return F.substr(F.array_join(F.slice(c["blocks"], first + 1, count), ""), start - first * TEXT_BLOCK + 1, end - start)

        places = F.sequence(F.lit(0), F.size(c["spans"]) - 1)
        at = let(F.transform(c["spans"], lambda s: s["end"]), lambda x: _before(x, lambda a, b: F.greatest(a, b)))

        def cut(reached: Column) -> Column:
            named = F.filter(places, lambda i: F.get(c["spans"], i)["start"] >= F.get(reached, i))
            out = F.transform(
                named,
                lambda i: F.concat(
                    between(F.get(reached, i), F.get(c["spans"], i)["start"]),
                    F.lit("["),
                    F.upper(F.get(c["spans"], i)["kind"]),
                    F.lit("]"),
                ),
            )
            last = F.greatest(F.array_max(reached), F.get(c["spans"], F.size(c["spans"]) - 1)["end"])
            return F.concat(F.array_join(out, ""), between(last, c["n"]))

        return let(at, cut)

    blocks = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{TEXT_BLOCK}}}"), F.lit(0))
    parts = F.struct(kept.alias("spans"), blocks.alias("blocks"), F.length("text").alias("n"))
    clean = let(parts, lambda c: F.when(F.size(c["spans"]) > 0, write(c)))
    out = docs.withColumn("text", F.coalesce(clean, F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
