"""Markdown and delimiter-structured texts to rows. Each text is parsed where it lies, by array expressions;
nothing is shuffled, and a text's order is its array's order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.functions import text as X


def read_texts(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(doc, text) of whole files whose name fits; doc is the file's name."""
    files = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True)
    return files.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("doc"), F.col("value").alias("text"))


def lines_of(text: Column) -> Column:
    return F.split(text, "\r?\n", -1)


def _pipe(line: Column) -> Column:
    return F.trim(line).startswith("|")


def _from(lines: Column, at: Column) -> Column:
    """The lines from index at (from 0) on."""
    return F.slice(lines, at + 1, F.greatest(F.lit(0), F.size(lines) - at))


def _first(lines: Column, test) -> Column:
    """Index of the first line that passes, from 0; -1 if none does."""
    return F.array_position(F.transform(lines, lambda x: F.coalesce(test(x), F.lit(False))), F.lit(True)).cast("int") - 1


def table_parts(docs: DataFrame, title: str = "## Leads Table", text: str = "text") -> DataFrame:
    """(doc, part, text): each document from one title to the next, a row a title, counted from 0."""
    parts = F.split(F.col(text), f"\\Q{title}\\E", -1)
    cut = docs.select("doc", F.posexplode(F.slice(parts, F.lit(2), F.greatest(F.size(parts), F.lit(0)))).alias("part", "_rest"))
    return cut.select("doc", F.col("part").cast("long").alias("part"), F.concat(F.lit(title), "_rest").alias("text"))


def all_table_rows(docs: DataFrame, title: str = "## Leads Table", text: str = "text") -> DataFrame:
    """(doc, part, pos, row, extra_cells) of every table of a document: the first one under each title, as
    table_rows reads it, as far as the next title. part is the title's number, so one without a table is passed over."""
    parts = table_parts(docs, title, text).select(F.struct("doc", "part").alias("doc"), "text")
    return table_rows(parts, title).select("doc.doc", "doc.part", "pos", "row", "extra_cells")


def table_rows(docs: DataFrame, title: str = "## Leads Table", text: str = "text") -> DataFrame:
    """(doc, pos, row, extra_cells) of the first table under the title. Its header is the first pipe row that
    names a company and a hook; a rule row under it is left out; the table ends at the first other line.
    row: map of lower-cased header to cell, "" where cells are missing; cells beyond the header are counted."""
    below = docs.withColumn("_l", lines_of(F.col(text)))
    below = below.withColumn("_t", _first(F.col("_l"), lambda x: F.contains(x, F.lit(title))))
    below = below.withColumn("_l", F.when(F.col("_t") >= 0, _from(F.col("_l"), F.col("_t") + 1)))
    is_header = lambda x: _pipe(x) & F.contains(F.lower(x), F.lit("company")) & F.contains(F.lower(x), F.lit("hook"))
    headed = below.withColumn("_h", _first(F.col("_l"), is_header)).filter(F.col("_h") >= 0)
    header = X.table_cells(F.lower(F.get("_l", F.col("_h"))))
    body = headed.select("doc", header.alias("_names"), _from(F.col("_l"), F.col("_h") + 1).alias("_b"))
    rule = F.coalesce(F.get("_b", F.lit(0)).rlike("^\\s*\\x7C[\\s:\\x7C-]+\\x7C\\s*\\z"), F.lit(False))
    body = body.withColumn("_b", F.when(rule, _from(F.col("_b"), F.lit(1))).otherwise(F.col("_b")))
    end = _first(F.col("_b"), lambda x: ~_pipe(x))
    rows = body.select("doc", "_names", F.posexplode(F.when(end >= 0, F.slice("_b", F.lit(1), end)).otherwise(F.col("_b"))).alias("pos", "_line"))
    rows = rows.withColumn("_cells", X.table_cells(F.col("_line")))
    # of equal names the last counts
    names = F.array_distinct("_names")
    place = lambda n: F.size("_names") - F.array_position(F.reverse("_names"), n).cast("int")
    made = F.map_from_arrays(names, F.transform(names, lambda n: F.coalesce(F.get("_cells", place(n)), F.lit(""))))
    return rows.select("doc", F.col("pos").cast("long").alias("pos"), made.alias("row"), F.greatest(F.lit(0), F.size("_cells") - F.size("_names")).cast("long").alias("extra_cells"))


def seeds(docs: DataFrame, default_city: str = "Unknown", default_tier: str = "untiered", every: bool = False) -> DataFrame:
    """(doc, pos, city, tier, diagnosis) of dial sheets; names, phones and sites never leave this step. Of a sheet with
    several tables the first is read; `every` reads all, and part tells which one a row is from."""
    sheets = docs.filter(F.contains("text", F.lit("## Leads Table")))
    rows = all_table_rows(sheets) if every else table_rows(sheets)
    cell = lambda k: F.coalesce(F.try_element_at("row", F.lit(k)), F.lit(""))
    made = rows.select(
        "doc",
        *(["part"] if every else []),
        "pos",
        F.coalesce(F.nullif(cell("city"), F.lit("")), F.lit(default_city)).alias("city"),
        F.coalesce(F.nullif(cell("tier"), F.lit("")), F.lit(default_tier)).alias("tier"),
        X.scrub_identity(cell("hook")).alias("diagnosis"),
    )
    return made.filter(F.col("diagnosis") != "")


# Headers, fields and block names are the formats' own.
HEADER = r"^###\s+(\d+)\.\s+(.+?)\s+—\s+Score:\s*([0-9.]+/10)\s*\z"
LEAD_FIELDS = (("phone", "- **Phone:**"), ("website", "- **Website:**"), ("owner", "- **Owner:**"), ("angle", "- **Outreach angle:**"))


def ranked_leads(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc, rank, name, score, phone, website, owner, angle) of "### n. name — Score: x/10" blocks. A block's
    lines are those up to the next header; of equal fields the last counts."""
    trimmed = F.transform(lines_of(F.col(text)), lambda x: F.trim(x))
    held = docs.select("doc", trimmed.alias("_l"))
    starts = F.filter(F.transform("_l", lambda x, i: F.when(x.rlike(HEADER), i)), lambda i: i.isNotNull())
    held = held.withColumn("_s", starts).select("doc", "_l", "_s", F.posexplode("_s").alias("_k", "_at"))
    end = F.coalesce(F.get("_s", F.col("_k") + 1), F.size("_l"))
    block = held.select("doc", F.get("_l", F.col("_at")).alias("_head"), F.slice("_l", F.col("_at") + 2, end - F.col("_at") - 1).alias("_body"))

    def field(prefix: str) -> Column:
        own = F.filter("_body", lambda x: x.startswith(prefix))
        return F.trim(F.substr(F.try_element_at(own, F.lit(-1)), F.lit(len(prefix) + 1)))

    made = {name: field(prefix) for name, prefix in LEAD_FIELDS}
    made["angle"] = F.regexp_replace(made["angle"], '^"|"\\z', "")
    return block.select(
        "doc",
        F.regexp_extract("_head", HEADER, 1).cast("long").alias("rank"),
        F.regexp_extract("_head", HEADER, 2).alias("name"),
        F.regexp_extract("_head", HEADER, 3).alias("score"),
        *(c.alias(n) for n, c in made.items()),
    )


def sections(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc, ord, title, body) by second-level headings; what stands before them is "__header__". Of equal
    titles the last counts, at the place of the first."""
    parts = F.split(F.concat(F.lit("\n"), F.col(text)), "\n(?=## )", -1)
    cut = F.transform(
        parts,
        lambda p, i: F.struct(
            F.when(i == 0, "__header__").otherwise(F.trim(F.substr(F.substring_index(p, "\n", 1), F.lit(4)))).alias("title"),
            F.trim(F.regexp_replace(F.when((i == 0) | F.contains(p, F.lit("\n")), F.substr(p, F.instr(p, "\n") + 1)).otherwise(""), X.EDGES, "")).alias("body"),
        ),
    )
    held = docs.select("doc", cut.alias("_p"))
    titles = F.array_distinct(F.transform("_p", lambda p: p["title"]))
    last = lambda t: F.try_element_at(F.filter("_p", lambda p: p["title"] == t), F.lit(-1))["body"]
    rows = held.select("doc", F.posexplode(F.transform(titles, lambda t: F.struct(t.alias("title"), last(t).alias("body")))).alias("ord", "s"))
    return rows.select("doc", F.col("ord").cast("long").alias("ord"), "s.title", "s.body").filter("title <> '__header__' or body <> ''")


PLATFORMS = ("linkedin", "instagram", "facebook")
_BLOCK = "(?i)===(LINKEDIN|INSTAGRAM|FACEBOOK)==="


def delimited_posts(docs: DataFrame, text: str = "text", whole_body: bool = True) -> DataFrame:
    """(doc, platform, headline, body) of "===NAME===" blocks with a HEADLINE: line and a BODY:. Without BODY:
    the rest of the block is the body; one without headline or body is left out; of equal names the last
    good one counts. whole_body False keeps a body's first line alone."""
    names = F.transform(F.regexp_extract_all(F.col(text), F.lit(_BLOCK), F.lit(1)), F.lower)
    blocks = F.split(F.col(text), _BLOCK, -1)
    trim = lambda c: F.regexp_replace(c, X.EDGES, "")
    pairs = F.transform(names, lambda n, i: F.struct(n.alias("platform"), trim(F.get(blocks, i + 1)).alias("block"), i.alias("i")))
    rows = docs.select("doc", F.explode(pairs).alias("p")).select("doc", "p.*")
    headline = F.substring(trim(F.regexp_extract("block", r"(?m)^HEADLINE:\s*(.+?)$", 1)), 1, 120)
    said = F.regexp_extract("block", r"(?ms)^BODY:\s*(.+?)(?:===|\z)" if whole_body else r"(?m)^BODY:\s*(.+?)(?:===|$)", 1)
    rest = F.regexp_replace("block", "(?m)^HEADLINE:[^\n]*\n?", "")
    body = F.coalesce(F.nullif(trim(said), F.lit("")), trim(rest))
    good = rows.select("doc", "platform", "i", headline.alias("headline"), body.alias("body")).filter("headline <> '' and body <> ''")
    best = good.groupBy("doc", "platform").agg(F.max_by(F.struct("headline", "body"), "i").alias("b"))
    return best.select("doc", "platform", "b.headline", "b.body")
