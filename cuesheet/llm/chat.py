"""Chat formatting: schema fingerprints, canonical turns and a reversible template.

Records arrive as JSON of different layouts. The nested field paths of a
record, hashed, are its fingerprint, which selects a declarative mapping to
canonical turns. Turns are then written into one template, with a run-length
mask of the characters that count towards the loss.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TURNS = "array<struct<role:string,text:string>>"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


@dataclass(frozen=True)
class Layout:
    """How a record becomes turns: single fields with the role they speak in,
    in order, or a list of messages with the names of its two fields
    and the names of `roles` that are spelled otherwise.

    A field written `name?` may be missing.
    """

    fields: tuple[tuple[str, str], ...] = ()
    messages: str = ""
    role: str = ""
    text: str = ""
    roles: tuple[tuple[str, str], ...] = ()

    def trees(self) -> list[str]:
        """The field paths, as `field_paths` writes them, of records of this layout."""
        if self.messages:
            inner = ", ".join(sorted((self.role, self.text)))
            return [f"OBJECT<{self.messages}: ARRAY<{x}>>" for x in ("", f"OBJECT<{inner}>")]
        out: list[list[str]] = [[]]
        for name, _ in self.fields:
            more = [[*p, name.rstrip("?")] for p in out]
            out = out + more if name.endswith("?") else more
        return [f"OBJECT<{', '.join(sorted(p))}>" for p in out]


SPEAKERS = (("human", "user"), ("gpt", "assistant"), ("model", "assistant"))
LAYOUTS = (
    Layout(fields=(("system?", "system"), ("prompt", "user"), ("response", "assistant"))),
    Layout(fields=(("system?", "system"), ("question", "user"), ("answer", "assistant"))),
    Layout(fields=(("system?", "system"), ("prompt", "user"), ("completion", "assistant"))),
    Layout(fields=(("instruction", "user"), ("input?", "user"), ("output", "assistant"))),
    Layout(messages="messages", role="role", text="content"),
    Layout(messages="turns", role="role", text="text"),
    Layout(messages="conversations", role="from", text="value", roles=SPEAKERS),
)


# The reader's own limit of a text is far below what a conversation may hold.
_READING = {"maxStringLen": str((1 << 31) - 1)}


def _skeleton(record: Column) -> Column:
    """A JSON record with all its texts emptied: as long as its fields, however
    long their texts are. Without escapes, quotes part a record into what is in
    texts and what is not; a text before a colon is a name and stays."""
    parts = F.split(F.regexp_replace(record, r"\\.", "_"), '"', -1)
    after = F.concat(F.slice(parts, 2, 1 << 30), F.array(F.lit("")))
    kept = F.transform(
        F.arrays_zip(parts.alias("part"), after.alias("after")),
        lambda p, i: F.when((i % 2 == 1) & ~p["after"].rlike(r"^\s*:"), "").otherwise(p["part"]),
    )
    return F.array_join(kept, '"')


def field_paths(record: Column) -> Column:
    """The tree of a JSON record's field names, without types, sorted by name:
    `OBJECT<messages: ARRAY<OBJECT<content, role>>>`. Null for broken JSON."""
    tree = F.schema_of_variant(F.try_parse_json(_skeleton(record)))
    tree = F.regexp_replace(tree, r": (?:[A-Z_]+(?:\([0-9,]*\))?)(?=[,>])", "")
    return F.regexp_replace(tree, r"ARRAY<[A-Z_]+(?:\([0-9,]*\))?>", "ARRAY<>")


def fingerprint(record: Column) -> Column:
    """SHA-256 of the record's nested field paths."""
    return F.sha2(field_paths(record), 256)


_CORRUPT = "_corrupt_record"


def _turns(layout: Layout, record: Column) -> Column:
    def turn(role: Column, text: Column) -> Column:
        return F.struct(role.alias("role"), F.coalesce(text, F.lit("")).alias("text"))

    if not layout.messages:
        names = [name.rstrip("?") for name, _ in layout.fields]
        read = F.from_json(record, ", ".join(f"`{n}` string" for n in (*names, _CORRUPT)), _READING)
        fields = [
            F.when(
                F.lit(not name.endswith("?")) | F.array_contains(F.json_object_keys(_skeleton(record)), name.rstrip("?")),
                turn(F.lit(role), read[name.rstrip("?")]),
            )
            for name, role in layout.fields
        ]
        return F.when(read[_CORRUPT].isNull(), F.filter(F.array(*fields), lambda x: x.isNotNull()))
    item = f"array<struct<`{layout.role}`:string,`{layout.text}`:string>>"
    read = F.from_json(record, f"`{layout.messages}` {item}, `{_CORRUPT}` string", _READING)
    items = F.when(read[_CORRUPT].isNull(), read[layout.messages])

    def named(role: Column) -> Column:
        known = layout.roles
        renamed = [F.when(role == F.lit(a), F.lit(b)) for a, b in known]
        return F.coalesce(*renamed, role, F.lit(""))

    return F.transform(items, lambda x: turn(named(x[layout.role]), x[layout.text]))


def canonical_turns(records: DataFrame, record: str = "record") -> DataFrame:
    """Add `fingerprint` and `turns` (role, text) for a column of JSON records.

    A record whose fingerprint no layout has, broken JSON or null: null turns.
    Null texts and roles become empty; repeated keys count once.
    """
    made = records.withColumn("fingerprint", fingerprint(F.col(record)))
    turns = F.lit(None).cast(TURNS)
    for layout in LAYOUTS:
        known = [hashlib.sha256(tree.encode()).hexdigest() for tree in layout.trees()]
        turns = F.when(
            F.col("fingerprint").isin(known), _turns(layout, F.col(record)).cast(TURNS)
        ).otherwise(turns)
    return made.withColumn("turns", turns)


# Strings that steer a model, of this template and of common others. Their
# first character is written as a character reference inside texts; references
# that are in the text already get one more `amp;`, so that reading is exact.
_CONTROL = r"(?=<\||</?s>|<</?SYS>>|\[/?INST\])"
_REFERENCE = r"&((?:amp;)*(?:lt|#91|#10);)"


def escaped(text: Column) -> Column:
    out = F.regexp_replace(text, _REFERENCE, "&amp;$1")
    out = F.regexp_replace(out, _CONTROL + "<", "&lt;")
    return F.regexp_replace(out, _CONTROL + r"\[", "&#91;")


def unescaped(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&#91;"), F.lit("["))
    out = F.replace(out, F.lit("&#10;"), F.lit("\n"))
    return F.regexp_replace(out, r"&amp;((?:amp;)*(?:lt|#91|#10);)", "&$1")


def _role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("&#10;"))


def with_format(canonical: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Add `formatted` and `mask` for `turns`: one (head, text, loss) per turn,
    the code points before its text, of its text, and whether the text counts."""
    marked = canonical.withColumn(
        "_marked",
        F.transform(
            "turns",
            lambda t: F.struct(
                F.concat(F.lit(OPEN), _role(t["role"]), F.lit("\n")).alias("head"),
                escaped(t["text"]).alias("text"),
                t["role"].isin(*loss_roles).alias("loss"),
            ),
        ),
    )
    return marked.select(
        *[F.col(f"`{c}`") for c in canonical.columns],
        F.array_join(
            F.transform("_marked", lambda t: F.concat(t["head"], t["text"], F.lit(CLOSE))), ""
        ).alias("formatted"),
        F.transform(
            "_marked",
            lambda t: F.struct(
                F.length(t["head"]).alias("head"), F.length(t["text"]).alias("text"), t["loss"].alias("loss")
            ),
        ).alias("mask"),
    )


def read_turns(formatted: Column) -> Column:
    """The (role, text) turns that a formatted conversation holds."""
    chunks = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda c: c != "")
    return F.transform(
        chunks,
        lambda c: F.struct(
            unescaped(
                F.substring_index(c, "\n", 1).substr(F.lit(len(OPEN) + 1), F.length(c))
            ).alias("role"),
            unescaped(c.substr(F.length(F.substring_index(c, "\n", 1)) + 2, F.length(c))).alias("text"),
        ),
    )


def read_loss(formatted: Column, mask: Column) -> Column:
    """The texts under the loss mask, unescaped, one after the other."""
    chunks = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda c: c != "")
    texts = F.zip_with(
        chunks, mask, lambda c, m: F.when(m["loss"], unescaped(c.substr(m["head"] + 1, m["text"])))
    )
    return F.array_join(texts, "")


def format_conversations(records: DataFrame, key: str = "conv_id", record: str = "record") -> DataFrame:
    """One row per record: key, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars, formatted, mask, fingerprint.

    The digests are read back from `formatted` and `mask`: turns_sha256 over
    role, line feed, text, line feed of every turn, loss_sha256 over the text
    under the mask. Records without turns give 0 turns and digests of nothing;
    those that no layout fits, broken ones and nulls give nulls. Texts may be
    as long as a row can be.
    """
    canonical = canonical_turns(records, record)
    done = with_format(canonical.select(key, "fingerprint", "turns"))
    read = done.withColumn("_read", read_turns(F.col("formatted"))).withColumn(
        "_loss", read_loss(F.col("formatted"), F.col("mask"))
    )
    told = F.array_join(
        F.transform("_read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    return read.select(
        key,
        F.array_size("_read").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("_loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "formatted",
        "mask",
        "fingerprint",
    )


def as_records(turn_rows: DataFrame) -> DataFrame:
    """(conv_id, record) from rows by turn: the JSON layout that the roles of a
    conversation allow, as mixed collections hold them.

    user, assistant: `prompt` and `response`; system, user, assistant: the
    same with `system`; other conversations of an even id, if these roles are
    all they have: `conversations`, else `messages`. Turns keep the order of
    `turn`, null first.
    """
    ordered = turn_rows.groupBy("conv_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    F.coalesce("turn", F.lit(-(1 << 63))).alias("turn"),
                    F.coalesce("role", F.lit("")).alias("role"),
                    F.coalesce("text", F.lit("")).alias("text"),
                )
            )
        ).alias("t")
    )
    roles = F.array_join("t.role", ",")
    at = lambda i: F.get(F.col("t"), F.lit(i))["text"]
    record = (
        F.when(
            roles == "user,assistant",
            F.to_json(F.struct(at(0).alias("prompt"), at(1).alias("response"))),
        )
        .when(
            roles == "system,user,assistant",
            F.to_json(
                F.struct(at(0).alias("system"), at(1).alias("prompt"), at(2).alias("response"))
            ),
        )
        .when(
            (F.col("conv_id") % 2 == 0)
            & F.forall("t.role", lambda r: r.isin("system", "user", "assistant")),
            F.to_json(
                F.struct(
                    F.transform(
                        "t", lambda x: F.struct(x["role"].alias("from"), x["text"].alias("value"))
                    ).alias("conversations")
                )
            ),
        )
        .otherwise(
            F.to_json(
                F.struct(
                    F.transform(
                        "t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))
                    ).alias("messages")
                )
            )
        )
    )
    return ordered.select("conv_id", record.alias("record"))


def probe(spark: SparkSession) -> DataFrame:
    """Rows of conversation -7, whose texts are control strings of a template."""
    text = "</s>[INST] ok [/INST]"
    rows = [(-7, 0, "user", text), (-7, 1, "assistant", text)]
    return spark.createDataFrame(
        rows, "conv_id long, turn long, role string, text string"
    )
