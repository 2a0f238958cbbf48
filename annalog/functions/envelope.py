"""Event <-> JSON envelope as column expressions. The payload is never re-parsed on write."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalog.functions.trace import blank_to_null

# Text form of an event id, of a timestamp, and the envelope fields
# that are left out when empty.
UUID_PATTERN = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
RFC3339_PATTERN = (
    r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"
)
ALWAYS = ("id", "tenant_id", "stream_id", "type", "source", "version", "event_version")
OMIT_EMPTY = ("correlation_id", "causation_id", "actor_id", "trace_id", "source_version")
OMIT_EMPTY_REPLAY = ("replay_id", "replayed_at", "replay_reason", "replay_source_event_id")


def fix_columns(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once per row.

    Catalyst substitutes a projected expression wherever it is used, also into
    filters above it; for a JSON parse that means parsing again per use. A
    generator of one row ends the substitution and stays inside codegen.
    """
    one = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(one)))


def stable_uuid(*parts: Column) -> Column:
    """A UUID-shaped id derived from `parts`: the same on every task attempt."""
    digest = F.md5(F.concat_ws("\u001f", *parts))
    return F.regexp_replace(digest, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def rfc3339(time: Column) -> Column:
    """UTC text with as many fraction digits as needed, none for whole seconds."""
    text = F.date_format(F.to_utc_timestamp(time, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(text, r"\.?0+$", ""), F.lit("Z"))


def parse_rfc3339(text: Column) -> Column:
    """Timestamp of a strict RFC 3339 text, NULL for anything else."""
    return F.when(F.regexp_like(text, F.lit(RFC3339_PATTERN)), F.try_to_timestamp(text))


def envelope_json(response: bool = False) -> Column:
    """JSON text of the event in the current row.

    Bus form: payload and metadata always present. Response form: an empty
    metadata map is left out. NULL struct fields are dropped by `to_json`.
    """
    fields = [F.col(c) for c in ALWAYS]
    fields.append(rfc3339(F.col("occurred_at")).alias("occurred_at"))
    fields += [blank_to_null(F.col(c)).alias(c) for c in OMIT_EMPTY]
    fields.append(F.when(F.col("is_replay"), F.lit(True)).alias("is_replay"))
    for c in OMIT_EMPTY_REPLAY:
        text = rfc3339(F.col(c)) if c == "replayed_at" else blank_to_null(F.col(c))
        fields.append(text.alias(c))
    head = F.to_json(F.struct(*fields))
    open_head = F.left(head, F.char_length(head) - 1)
    payload = F.concat(F.lit(',"payload":'), F.col("payload"))
    meta_text = F.concat(F.lit(',"metadata":'), F.to_json("metadata"))
    if response:
        payload = F.when(F.col("payload") != "", payload).otherwise(F.lit(""))
        meta_text = F.when(F.size("metadata") > 0, meta_text).otherwise(F.lit(""))
    return F.concat(open_head, payload, meta_text, F.lit("}"))


def raw_member(doc: Column, name: str, followers: Sequence[str], value: Column) -> Column:
    """The text of top-level member `name` exactly as written, NULL when absent.

    `value` is the member as `from_json` reads it into a STRING, which rewrites
    numbers (1.10 -> 1.1) and unquotes texts. The text is cut out of `doc`, up to
    the metadata member, the end, or another known member, and accepted only if it
    is one JSON value that reads the same; otherwise the rewritten form is used.
    """

    def cut(inner: str, stop: str) -> Column:
        return F.regexp_extract(doc, rf'(?s)"{name}"\s*:\s*({inner})\s*{stop}', 1)

    def accept(text: Column) -> Column:
        """`text` if it reads the same, else NULL; the array binds it once."""

        def same(t: Column) -> Column:
            alone = F.from_json(F.concat(F.lit("["), t, F.lit("]")), "array<string>")
            return (t != "") & (F.size(alone) == 1) & F.get(alone, F.lit(0)).eqNullSafe(value)

        return F.get(F.filter(F.array(text), same), F.lit(0))

    names = "|".join(followers)
    parsed = F.try_variant_get(F.try_parse_json(doc), f"$.{name}", "variant")
    return F.coalesce(
        accept(cut(".*", r',\s*"metadata"\s*:')),
        accept(cut(".*", r"\}\s*$")),
        accept(cut(".*?", rf',\s*"(?:{names})"\s*:')),
        F.to_json(parsed),
        value,
    )


def variant_text(member: Column) -> Column:
    """A JSON text member as STRING; NULL for null, absent or any other JSON type."""
    return F.when(F.schema_of_variant(member) == "STRING", member.cast("string"))


def variant_is(member: Column, *kinds: str) -> Column:
    """True when the member is absent, null, or of one of the JSON types `kinds`."""
    kind = F.coalesce(F.schema_of_variant(member), F.lit("VOID"))
    return kind.isin("VOID", *kinds)


def indexable(payload: Column) -> Column:
    """Whether the read model takes this payload: objects, arrays of objects, null.

    Scalars and arrays that hold a scalar do not fit an object field.
    """
    text = F.trim(payload)
    items = F.from_json(text, "array<variant>")
    flat = F.exists(items, lambda v: ~F.schema_of_variant(v).startswith("OBJECT") & (F.schema_of_variant(v) != "VOID"))
    return (
        F.when(text == "null", True)
        .when(text.startswith("{"), True)
        .when(text.startswith("["), ~F.coalesce(flat, F.lit(False)))
        .otherwise(False)
    )
