"""Chat formatting with typed content parts, in Spark SQL functions alone.

A turn is a role and an array of parts struct(kind, text, ref, tokens). A visitor over the parts writes text as it is
(control strings escaped) and an image, audio clip or document as a numbered placeholder, and records its reference and
the tokens into which it expands. Turns become

    <|role|>\\n text </s>\\n      (no blanks around the text)

and the marks around them never occur in what they hold: a backslash goes after the first character of each control
string inside a text or role, and each backslash is doubled. Where two text parts meet and the first could begin a
control string, a backslash goes between them; and so where a role meets the marks around it. unescaped() undoes that.

Null texts, roles, kinds and part arrays count as empty, null turns come first, ties go by role, then text; rows with a
null conversation form one conversation; an empty table gives no rows. A conversation becomes one row, and a turn's
parts one array, whatever their length; repeated rows are turns each. Other columns of the input are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a tokenizer would read as control.
CONTROL = ("[INST]", "[/INST]", "<s>", "</s>", "<|", "|>")
END = "</s>\n"
KINDS = ("image", "audio", "document")
#: The end of a text that a text after it could make into a control string.
OPEN = r"(?:<|</|<s|</s|\[|\[/|\[/?I|\[/?IN|\[/?INS|\[/?INST|\|)\z"


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescaped(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\\")), F.regexp_replace(text, r"(?s)\\(.?)", "$1")).otherwise(text)


def escaped_role(role: Column) -> Column:
    """A role between <| and |>: neither mark may be completed early."""
    back = F.lit("\\")
    out = F.concat(F.when(F.startswith(role, F.lit(">")), back).otherwise(""), escaped(role))
    return F.concat(out, F.when(F.endswith(role, F.lit("<")), back).otherwise(""))


def text_part(text: Column) -> Column:
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("tokens")))


def flattened(parts: Column) -> tuple[Column, Column, Column]:
    """Of an array of parts: the text with placeholders, the attachments (ordinal, kind, ref, tokens), their tokens in all."""
    kind = lambda p: F.coalesce(p["kind"], F.lit("text"))
    attached = lambda p: kind(p).isin(*KINDS)
    text = lambda p: F.coalesce(p["text"], F.lit(""))
    parts = F.coalesce(parts, F.filter(text_part(F.lit("")), lambda p: F.lit(False)))
    parts = F.filter(parts, lambda p: p.isNotNull() & (attached(p) | (F.length(text(p)) > 0)))
    files = F.transform(F.filter(parts, attached), lambda p, i: F.struct((i + 1).cast("int").alias("ordinal"), p["kind"].alias("kind"), p["ref"].alias("ref"), F.coalesce(p["tokens"], F.lit(0)).cast("long").alias("tokens")))
    places = F.filter(F.transform(parts, lambda p, i: F.when(attached(p), i)), lambda i: i.isNotNull())
    before = lambda i: F.element_at(parts, i)  # noqa: E731  element_at counts from 1, so this is the part before the i-th
    seam = lambda i: F.when((i > 0) & ~attached(before(F.greatest(i, F.lit(1)))) & F.rlike(text(before(F.greatest(i, F.lit(1)))), F.lit(OPEN)), F.lit("\\")).otherwise("")
    shown = F.transform(parts, lambda p, i: F.when(attached(p), F.concat(F.lit("<|"), kind(p), F.lit(":"), F.array_position(places, i).cast("string"), F.lit("|>"))).otherwise(F.concat(seam(i), escaped(text(p)))))
    tokens = F.aggregate(files, F.lit(0).cast("long"), lambda a, f: a + f["tokens"])
    return F.array_join(shown, ""), files, tokens


def formatted(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", trained: str = "assistant") -> DataFrame:
    """A row for each conversation: formatted, mask (spans struct(start, length) of the trained role's texts, in code points), attachments, n_expanded."""
    body, files, tokens = flattened(F.col(parts))
    x = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), body.alias("body"), files.alias("files"), tokens.alias("tokens"))
    x = x.withColumn("head", F.concat(F.lit("<|"), escaped_role(F.col("role")), F.lit("|>\n")))
    x = x.withColumn("piece", F.concat("head", "body", F.lit(END)))
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "body")
    x = x.withColumns({"i": F.row_number().over(w), "start": F.sum(F.length("piece")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.length("piece") + F.length("head")})
    one = F.struct("i", "piece", F.struct("start", F.length("body").cast("long").alias("length")).alias("span"), (F.col("role") == trained).alias("loss"), "files", "tokens")
    g = x.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("t"))
    return g.select(
        "conv_id",
        F.array_join(F.transform("t", lambda p: p["piece"]), "").alias("formatted"),
        F.transform(F.filter("t", lambda p: p["loss"]), lambda p: p["span"]).alias("mask"),
        F.flatten(F.transform("t", lambda p: p["files"])).alias("attachments"),
        F.aggregate("t", F.lit(0).cast("long"), lambda a, p: a + p["tokens"]).alias("n_expanded"),
    )


def parsed(text: Column) -> Column:
    """The turns struct(role, text) of a formatted text."""
    pieces = F.split(text, F.lit("</s>\n"))
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    at = lambda p: F.locate("|>\n", p)
    return F.transform(pieces, lambda p: F.struct(unescaped(F.substr(p, F.lit(3), at(p) - 3)).alias("role"), unescaped(F.substr(p, at(p) + 3)).alias("text")))


def masked(text: Column, mask: Column) -> Column:
    """All text under the mask, unescaped."""
    return F.array_join(F.transform(mask, lambda m: unescaped(F.substr(text, (m["start"] + 1).cast("int"), m["length"].cast("int")))), "")


def digests(chats: DataFrame) -> DataFrame:
    """What the formatted texts say, read back from them."""
    x = chats.select("conv_id", "formatted", F.size("attachments").cast("long").alias("n_attachments"), "n_expanded", parsed(F.col("formatted")).alias("t"), masked(F.col("formatted"), F.col("mask")).alias("loss"))
    said = F.array_join(F.transform("t", lambda p: F.concat(p["role"], F.lit("\n"), p["text"], F.lit("\n"))), "")
    return x.select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "n_attachments",
        "n_expanded",
    )
