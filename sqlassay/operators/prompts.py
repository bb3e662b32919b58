"""Prompt tables: one prompt per eval case, built by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlassay.functions import sqltext
from sqlassay.functions.text import fill

TEMPLATE = """You write {db_type} queries. Use the schema below.

{table_metadata_string}

{table_aliases}
{glossary}{k_shot_prompt}
{instructions}

Earlier attempt: {prev_invalid_sql}
Its error: {prev_error_msg}

Question: {user_question}
Query:"""


def decorate(cases: DataFrame) -> DataFrame:
    """Wrap instructions, glossary and examples in their headings; blank stays blank."""

    def headed(heading: str, text: Column) -> Column:
        filled = F.concat(F.lit(f"\n{heading}\n"), text, F.lit("\n"))
        return F.when(F.coalesce(text, F.lit("")) != "", filled).otherwise(F.lit(""))

    lines = F.replace(F.col("instructions"), F.lit(". "), F.lit(".\n"))
    examples = F.replace(F.col("k_shot_prompt"), F.lit("\\n"), F.lit("\n"))
    return cases.withColumns(
        {
            "instructions": headed("Follow the instructions below to generate the query:", lines),
            "glossary": headed("Use the following glossary terms if relevant:", F.col("glossary")),
            "k_shot_prompt": headed("Refer to these examples:", examples),
        }
    )


def _with_descriptions(catalog: DataFrame) -> DataFrame:
    return catalog if "description" in catalog.columns else catalog.withColumn("description", F.lit(""))


def table_texts(catalog: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """One CREATE TABLE text per table of a catalog."""
    name = F.when(F.col("column_name").contains(" "), F.concat(F.lit('"'), "column_name", F.lit('"'))).otherwise(
        F.col("column_name")
    )
    note = F.replace(F.coalesce("description", F.lit("")), F.lit("\n"), F.lit(" "))
    note = F.when(note != "", F.concat(F.lit(" --"), note)).otherwise(F.lit(""))
    lines = _with_descriptions(catalog).select(
        *keys, "table_name", "ordinal", F.concat(F.lit("  "), name, F.lit(" "), "type_class").alias("line"), note.alias("note")
    )
    columns = F.array_sort(F.collect_list(F.struct("ordinal", "line", "note")))
    tables = lines.groupBy(*keys, "table_name").agg(columns.alias("columns"))
    comma = F.transform(
        "columns",
        lambda c, i: F.concat(c["line"], F.when(i < F.size("columns") - 1, ",").otherwise(""), c["note"]),
    )
    text = F.concat(F.lit("CREATE TABLE "), "table_name", F.lit(" (\n"), F.array_join(comma, "\n"), F.lit("\n);\n"))
    return tables.select(*keys, "table_name", text.alias("ddl"))


def case_schema(case_files: DataFrame, catalog: DataFrame, cases: DataFrame | None = None) -> DataFrame:
    """Schema text of each case's tables in file order; a case whose files are not in the catalog has an empty one.

    Texts are made once per table; only the short table texts meet the cases. ``cases`` adds those
    that name no file at all.
    """
    named = case_files.withColumn("table_name", F.regexp_replace("file", r"\.[^.]*$", ""))
    joined = named.join(table_texts(catalog), "table_name", "left")
    ordered = F.array_sort(F.collect_list(F.when(F.col("ddl").isNotNull(), F.struct("file_no", "ddl"))))
    texts = joined.groupBy("case_id").agg(F.array_join(F.transform(ordered, lambda t: t["ddl"]), "").alias("schema_string"))
    if cases is None:
        return texts
    return cases.select("case_id").join(texts, "case_id", "left").withColumn("schema_string", F.coalesce("schema_string", F.lit("")))


def shuffle_schema(catalog: DataFrame, seed: int) -> DataFrame:
    """Seeded order of tables and columns: by a hash of seed and name, the same on every run."""
    keys = [c for c in ("schema_id",) if c in catalog.columns]
    table = F.md5(F.concat(F.lit(f"{seed}|"), "table_name"))
    column = F.md5(F.concat(F.lit(f"{seed}|"), "table_name", F.lit("|"), "column_name"))
    per_table = catalog.groupBy(*keys, "table_name").agg(
        F.array_sort(F.collect_list(F.struct(column.alias("h"), "column_name", "type_class"))).alias("columns")
    )
    per_schema = per_table.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(table.alias("h"), "table_name", "columns"))).alias("tables")
    )
    tables = per_schema.select(*keys, F.posexplode("tables").alias("table_no", "t"))
    columns = tables.select(*keys, "table_no", "t.table_name", F.posexplode("t.columns").alias("ordinal", "c"))
    return columns.select(*keys, "table_no", "table_name", "ordinal", "c.column_name", "c.type_class")


# --- aliases ------------------------------------------------------------------------


def _first_choice(name: Column) -> Column:
    """Initials of the words, or capitals and closing digits."""
    words = F.filter(F.split(name, "_"), lambda w: w != "")
    initials = F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")
    raised = F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, F.lit(2), F.length(name)))
    capitals = F.concat(F.regexp_replace(raised, "[^A-Z]", ""), F.regexp_extract(name, r"(\d+)$", 1))
    return F.lower(F.when(name.contains("_"), initials).otherwise(capitals))


def aliases(tables: DataFrame) -> DataFrame:
    """An alias per table of a schema ``(schema_id, table_no, table_name)``, in table order.

    Each choice depends on the aliases before it, so a schema's tables are folded in one
    row; a schema has few tables and there are many schemas.
    """
    ordered = tables.groupBy("schema_id").agg(F.array_sort(F.collect_list(F.struct("table_no", "table_name"))).alias("t"))
    reserved = F.array(*[F.lit(w) for w in sqltext.RESERVED_ALIASES])

    def step(done: Column, table: Column) -> Column:
        name = F.regexp_replace(table["table_name"], r"^.*\.", "")
        used = F.concat(F.transform(done, lambda d: d["alias"]), reserved)
        numbers = F.transform(
            F.sequence(F.lit(2), F.size(done) + len(sqltext.RESERVED_ALIASES) + 3),
            lambda n: F.concat(F.lower(F.substring(name, 1, 1)), n.cast("string")),
        )
        choices = F.concat(
            F.array(_first_choice(name), F.lower(F.substring(name, 1, 2)), F.lower(F.substring(name, 1, 3))), numbers
        )
        free = F.filter(choices, lambda c: ~F.array_contains(used, c) & (c != ""))
        return F.concat(
            done, F.array(F.struct(table["table_name"].alias("table_name"), F.element_at(free, 1).alias("alias")))
        )

    start = F.array().cast("array<struct<table_name:string,alias:string>>")
    folded = ordered.select("schema_id", F.posexplode(F.aggregate("t", start, step)).alias("table_no", "a"))
    return folded.select("schema_id", "table_no", "a.table_name", "a.alias")


def alias_text(alias_rows: DataFrame) -> DataFrame:
    """``-- table AS alias`` lines per schema."""
    line = F.concat(F.lit("-- "), "table_name", F.lit(" AS "), "alias", F.lit("\n"))
    ordered = F.array_sort(F.collect_list(F.struct("table_no", line.alias("line"))))
    return alias_rows.groupBy("schema_id").agg(
        F.array_join(F.transform(ordered, lambda a: a["line"]), "").alias("table_aliases")
    )


# --- prompts ------------------------------------------------------------------------

# Stand-ins for blank fields.
DEFAULTS = {
    "instructions": "Generate the SQL query.",
    "prev_invalid_sql": "N/A",
    "prev_error_msg": "N/A",
    "table_aliases": "-- No aliases provided.",
}
PLACES = [
    "user_question", "db_type", "instructions", "table_metadata_string", "k_shot_prompt", "glossary",
    "prev_invalid_sql", "prev_error_msg", "table_aliases",
]


def prompts(cases: DataFrame, template: str = TEMPLATE, db_type: str = "spark") -> DataFrame:
    """Fill the nine places; a field that is blank or absent gets its stand-in."""
    values = {}
    for place in PLACES:
        if place == "db_type":
            values[place] = F.lit(db_type)
        else:
            source = {"user_question": "question", "table_metadata_string": "schema_string"}.get(place, place)
            text = F.coalesce(F.col(source), F.lit("")) if source in cases.columns else F.lit("")
            stand_in = DEFAULTS.get(place, "")
            values[place] = F.when(text != "", text).otherwise(F.lit(stand_in)) if stand_in else text
    return cases.withColumn("prompt", fill(template, values))


def table_names(scripts: DataFrame) -> DataFrame:
    """Names of the CREATE TABLE statements of a script, in order, as written."""
    statements = scripts.select(
        "schema_id", F.posexplode(F.regexp_extract_all("ddl", F.lit(r"CREATE TABLE\s+([^(]+)\("), 1)).alias("table_no", "name")
    )
    return statements.select("schema_id", "table_no", F.trim("name").alias("table_name"))


def clean_metadata(scripts: DataFrame) -> DataFrame:
    """Comments, a comma before the closing bracket and the appendix of joinable columns off."""
    text = F.regexp_replace(F.col("ddl"), r"--[^\n]*", "")
    for ending in (", \n);", ",\n);"):
        text = F.replace(text, F.lit(ending), F.lit("\n);"))
    text = F.substring_index(text, "Here is a list of joinable columns:", 1)
    return scripts.withColumn("ddl", F.regexp_replace(text, r"^\s+|\s+$", ""))
