"""Fill-in-middle transformation, in built-in functions.

A text's units are its runs of ASCII letters and its other characters, one by one. A text is first cut into blocks of
BLOCK units by one regexp_extract_all; only the blocks in which the text is cut are opened into units by another, so
that the array of a long text has far fewer elements than the text has units. slice and array_join make the parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

UNIT = "[A-Za-z]+|[^A-Za-z]"
BLOCK = 64  # units of a block: a repeated group takes a frame of the stack for each
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, SPM = 90, 20  # per cent: texts from PLAIN on stay plain; of the others so many are suffix first


def _units(text: Column, pattern: str = UNIT) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _block(number: str) -> Column:
    """Units of the block that a cut lies in; none where the cut is behind the last block."""
    return F.coalesce(_units(F.get("blocks", F.col(number).cast("int"))), F.array().cast("array<string>"))


def _text(parts: str, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(parts, start.cast("int"), F.greatest(length, F.lit(0)).cast("int")), "")


def parsed(output: Column, form: Column) -> Column:
    """The text that an output of a form was made from. Sentinels are found from the left, as no sentinel occurs in a text and none can
    arise where text and sentinel meet: each starts with `<` and has no other."""
    p, s, m = (F.locate(x, output) for x in (PREFIX, SUFFIX, MIDDLE))
    after = lambda at: at + 3
    rest = F.substr(output, after(m))
    psm = F.concat(F.substr(output, after(p), s - after(p)), rest, F.substr(output, after(s), m - after(s)))
    spm = F.concat(F.substr(output, after(p), m - after(p)), rest, F.substr(output, after(s), p - after(s)))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """row (the document, all its columns), n, form, prefix, middle, suffix, output and restored of every row of (doc_id, text).

    n is the number of units. The first four groups of eight digits of the hex SHA-256 of `1:` and the doc_id (nothing, where it
    is null) are h1 to h4: the prefix ends after min(h1 % (n + 1), h2 % (n + 1)) units, the middle after the max. The form is
    plain for an empty or null text, one with a sentinel in it, or if h3 % 100 >= 90; else spm if h4 % 100 < 20, else
    psm. The parts are null in a plain row. Rows with the same doc_id are cut alike, each over its own units; repeated rows
    stay; other columns go along in `row` under any name; an empty table gives an empty one.
    """
    text = F.coalesce("row.text", F.lit(""))
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("row.doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    rows = docs.select(F.struct("*").alias("row")).select("row", text.alias("text"), digest.alias("digest"))
    plain = (F.col("text") == "") | F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE) | (h[2] % 100 >= PLAIN)
    rows = rows.select("row", "text", "digest", F.when(plain, "plain").when(h[3] % 100 < SPM, "spm").otherwise("psm").alias("form"), _units(F.col("text"), f"(?:{UNIT}){{1,{BLOCK}}}").alias("blocks"))
    full = F.greatest(F.size("blocks") - 1, F.lit(0))
    n = (full * BLOCK + F.when(F.size("blocks") > 0, F.size(_units(F.element_at("blocks", -1)))).otherwise(0)).cast("long")
    rows = rows.select("*", n.alias("n"))
    cuts = [x % (F.col("n") + 1) for x in h[:2]]
    rows = rows.select("row", "text", "form", "blocks", "n", F.least(*cuts).alias("c1"), F.greatest(*cuts).alias("c2"))
    rows = rows.select("*", F.floor(F.col("c1") / BLOCK).alias("b1"), F.floor(F.col("c2") / BLOCK).alias("b2"))
    cut = F.col("form") != "plain"
    rows = rows.select("*", F.when(cut, _block("b1")).alias("u1"), F.when(cut & (F.col("b2") > F.col("b1")), _block("b2")).otherwise(F.array().cast("array<string>")).alias("u2"))
    # blocks, with the one or two that are cut opened into units
    one = F.col("b1") == F.col("b2")
    before = F.slice("blocks", F.lit(1), F.col("b1").cast("int"))
    between = F.slice("blocks", (F.col("b1") + 2).cast("int"), F.greatest(F.col("b2") - F.col("b1") - 1, F.lit(0)).cast("int"))
    behind = F.slice("blocks", (F.col("b2") + 2).cast("int"), F.greatest(F.size("blocks") - F.col("b2") - 1, F.lit(0)).cast("int"))
    parts = F.concat(before, "u1", between, "u2", behind)
    end1 = F.col("b1") + F.col("c1") % BLOCK
    end2 = F.when(one, F.col("b1") + F.col("c2") % BLOCK).otherwise(F.col("b2") - 1 + F.size("u1") + F.col("c2") % BLOCK)
    rows = rows.select("row", "text", "form", "n", F.when(cut, parts).alias("parts"), end1.alias("e1"), end2.alias("e2"))
    e1, e2 = F.col("e1"), F.col("e2")
    rows = rows.select("row", "text", "form", "n", _text("parts", F.lit(1), e1).alias("prefix"), _text("parts", e1 + 1, e2 - e1).alias("middle"), _text("parts", e2 + 1, F.size("parts") - e2).alias("suffix"))
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    rows = rows.select("row", "n", "form", "prefix", "middle", "suffix", F.when(~cut, F.col("text")).when(F.col("form") == "psm", psm).otherwise(spm).alias("output"))
    return rows.select("*", parsed(F.col("output"), F.col("form")).alias("restored"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(documents(spark, sf_dir).select("doc_id", "text"))
    length = lambda c: F.length(c).cast("long")
    return made.select("row.doc_id", "n", "form", length("prefix").alias("prefix_chars"), length("middle").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


ORACLE = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), u AS (
  SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS u,
    ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d
), c AS (
  SELECT doc_id, text, u, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u
), p AS (
  SELECT doc_id, text, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM c
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN text ELSE p || m || s END) AS restored_sha256 FROM p
"""
