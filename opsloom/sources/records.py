"""JSON lines, sheets, configuration and state files to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.functions import numbers as N
from opsloom.functions import text as X
from opsloom.operators.rules import request_faults

GRAPH = "type string, name string, entityType string, observations array<string>, `from` string, `to` string, relationType string, source string"


def graph_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """Nodes and edges of JSON lines as one table with kind (entity, relation, header, skipped); blank lines
    are left out. Works on a read of text files or on any column of lines."""
    held = lines.filter(F.trim(line) != "").select(F.from_json(F.trim(line), GRAPH + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r")).select("r.*")
    kind = F.when(F.col("_bad").isNotNull(), "skipped").when(F.col("type").isin("entity", "relation"), F.col("type")).when(F.col("type") == "_aim", "header").otherwise("skipped")
    return held.select(kind.alias("kind"), "name", "entityType", "observations", "from", "to", "relationType")


def client_outcomes(entities: DataFrame, brand: str) -> DataFrame:
    """Publishable outcomes of a brand: four texts, two numbers, verifiable and shareable."""
    m = X.observation_map(F.col("observations"))
    field = lambda k: F.try_element_at("f", F.lit(k))
    texts = ("client_name", "client_niche", "metric_name", "time_window")
    typed = entities.filter("entityType = 'ClientOutcome'").select("name", m.alias("f")).select(
        F.col("name").alias("source_entity"),
        F.coalesce(field("brand_key"), field("brand")).alias("brand"),
        *(F.nullif(field(t), F.lit("")).alias(t) for t in texts),
        N.to_number(field("metric_value_before")).alias("before"),
        N.to_number(field("metric_value_after")).alias("after"),
        N.to_boolean(field("verifiable")).alias("verifiable"),
        N.to_boolean(field("shareable")).alias("shareable"),
    )
    return typed.filter(F.col("brand") == brand).filter(F.col("verifiable") & F.col("shareable")).dropna(subset=[*texts, "before", "after"])


def sheet_kind(header: Column) -> Column:
    """What a sheet is, by its header line; file names don't tell."""
    low = F.lower(header)
    has = lambda *names: F.forall(F.array(*map(F.lit, names)), lambda n: F.contains(low, n))
    return (
        F.when(has("google_rating", "outreach_angle"), "research")
        .when(has("business name", "postal code"), "import")
        .when(has("company name", "website", "postal code"), "import-12")
        .when(has("phone", "company name"), "patch")
        .otherwise("unknown")
    )


RESEARCH = "first_name string, last_name string, company_name string, phone string, email string, website string, google_rating string, review_count string, years_in_business string, employee_count_estimate string, city string, outreach_angle string, niche string, score double"


def research_rows(lines: DataFrame, line: str = "value") -> DataFrame:
    """Rows of research sheets out of CSV lines; numbers that aren't plain are null beside their text."""
    r = lines.select(F.from_csv(line, RESEARCH, {"escape": '"'}).alias("r")).select("r.*")
    return r.withColumns({"rating": N.dirty_number(F.col("google_rating")), "reviews": N.dirty_number(F.col("review_count")), "phone_key": F.right(F.regexp_replace("phone", "[^0-9]", ""), F.lit(10))})


def snapshot_rows(files: DataFrame, schema: str, version: int = 1, text: str = "text") -> DataFrame:
    """Records of JSON state files; another schema version ends the job with an error."""
    held = files.select(F.from_json(text, f"schemaVersion int, records array<struct<{schema}>>").alias("s"))
    guarded = held.withColumn("ok", F.assert_true(F.col("s.schemaVersion").eqNullSafe(F.lit(version)), "state has another schema version"))
    return guarded.filter(F.col("ok").isNull()).select(F.explode("s.records").alias("r")).select("r.*")


def form_requests(asked: DataFrame, body: str) -> DataFrame:
    """asked without its JSON bodies, with faults (why a request is refused; a broken body is one) and, of good
    ones, tags; refused ones have null tags."""
    kind = "firstName string, lastName string, email string, phone string, business string, businessType string, budget string, _bad string"
    read = asked.withColumn("_r", F.from_json(body, kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    faults = F.when(F.col("_r").isNull() | F.col("_r._bad").isNotNull(), F.array(F.lit("invalid JSON"))).otherwise(request_faults(F.col("_r.firstName"), F.col("_r.email"), F.col("_r.phone")))
    judged = read.withColumn("faults", faults)
    return judged.withColumn("tags", F.when(F.size("faults") == 0, X.tags(["request", "hot"], F.col("_r.businessType")))).drop("_r", body)


CLOCK = r"^([01][0-9]|2[0-3]):[0-5][0-9]\z"


def brand_rows(spark: SparkSession, files: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Valid and rejected brands of YAML texts by file name: a brand's file has a supported version, its key
    as name, weights of 0 to 1 and slot times HH:MM; names with "_" in front are left out. A handful of
    configuration files, so they are parsed on the driver."""
    import re

    import yaml

    good, bad = [], []
    for name, text in sorted(files.items()):
        if not name.endswith(".yaml") or name.startswith("_"):
            continue
        try:
            c = yaml.safe_load(text)
            why = None
            if c.get("schema_version") != 1:
                why = "version"
            elif f"{c.get('brand_key')}.yaml" != name:
                why = "key"
            elif any(not 0 <= a.get("weight", 0) <= 1 for a in c.get("positioning", {}).get("voice_anchors", [])):
                why = "weight"
            elif any(not re.match(CLOCK.replace(r"\z", "$"), t) for ts in (c.get("cadence", {}).get("slot_times") or {}).values() for t in ts):
                why = "slot"
        except (yaml.YAMLError, AttributeError, TypeError):
            why = "syntax"
        if why:
            bad.append((name, why))
        else:
            times = {k: list(v) for k, v in (c.get("cadence", {}).get("slot_times") or {}).items()}
            good.append((c["brand_key"], c.get("display_name"), bool(c.get("status", {}).get("active")), bool(c.get("default_brand")), times))
    schema = "brand_key string, display_name string, active boolean, default_brand boolean, slot_times map<string,array<string>>"
    return spark.createDataFrame(good, schema), spark.createDataFrame(bad, "file string, reason string")


def inventory(files: DataFrame, pattern: str) -> DataFrame:
    """(doc, n) of matches of a pattern in each text."""
    return files.select("doc", F.regexp_count("text", F.lit(pattern)).cast("long").alias("n"))


def first_samples(files: DataFrame, pattern: str, n: int = 3) -> DataFrame:
    """(doc, pos, sample): the first n matches of each text."""
    hits = F.slice(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), 1, n)
    return files.select("doc", F.posexplode(hits).alias("pos", "sample")).withColumn("pos", F.col("pos").cast("long"))
