"""From model responses and page text to typed question rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.functions.text import clean_page_text, filled_or, python_strip, repaired_json, title_case

# Accepted names of the fields, the canonical one first.
ALIASES = {
    "question_number": ("question_number", "q_no", "no", "number"),
    "section_name": ("section_name", "section", "sec"),
    "subject": ("subject", "sub"),
    "question_text": ("question_text", "text", "q_text"),
    "correct_answer": ("correct_answer", "answer", "correct_option"),
    "question_type": ("question_type", "q_type", "type"),
}
ENVELOPE = "candidates array<struct<content:struct<parts:array<struct<text:string>>>>>"
SECTION = "struct<start_q:int,end_q:int,q_count:int,marks:double,negative_marks:double,type:string>"
CONFIG = f"title string, duration int, standard string, category string, subjects map<string,struct<sections:map<string,{SECTION}>>>, _corrupt_record string"
# How pages are sent for extraction.
PAGE_CHARS, PAGES_PER_BATCH = 12000, 2
PAGE_MARKER = "--- PAGE %d SEARCHABLE TEXT {} ---"


def response_text(envelope: Column) -> Column:
    """Non-empty parts of the first candidate, one below the other; [] without any."""
    parts = F.try_element_at(F.from_json(envelope, ENVELOPE)["candidates"], F.lit(1))["content"]["parts"]
    texts = F.filter(F.transform(parts, lambda p: p["text"]), lambda x: F.length(x) > 0)
    return filled_or(python_strip(F.array_join(texts, "\n")), "[]")


def elements(responses: DataFrame) -> DataFrame:
    """One row per element of each response's repaired JSON (id, pos, item variant): a list, or an object's questions or
    data list, or the object itself."""
    parsed = responses.withColumn("v", F.try_parse_json(repaired_json(F.col("response_text"))))
    kind = F.schema_of_variant("v")
    inner = F.coalesce(F.try_variant_get("v", "$.questions", "array<variant>"), F.try_variant_get("v", "$.data", "array<variant>"), F.array("v"))
    items = F.when(kind.startswith("ARRAY"), F.try_variant_get("v", "$", "array<variant>")).when(kind.startswith("OBJECT"), inner)
    return parsed.select(*responses.columns, F.posexplode(items).alias("pos", "item"))


def field(item: Column, name: str, kind: str = "string") -> Column:
    return F.coalesce(*(F.try_variant_get(item, f"$.{a}", kind) for a in ALIASES.get(name, (name,))))


def drop_markers(items: DataFrame) -> DataFrame:
    """Without what is no object, and without the model's own error objects."""
    obj = F.schema_of_variant("item").startswith("OBJECT")
    return items.where(obj & ~F.coalesce(F.try_variant_get("item", "$.error", "string") == "QUESTION_COUNT_MISMATCH", F.lit(False)))


def page_number(item: Column, first_page: Column) -> Column:
    """A number, or the first digits of a text, or the batch's first page."""
    raw = F.try_variant_get(item, "$.page_number", "string")
    return F.coalesce(F.nullif(F.regexp_extract(raw, r"\d+", 0), F.lit("")).try_cast("int"), first_page)


def typed(items: DataFrame, plan: DataFrame) -> DataFrame:
    """Canonical, defaulted rows; a plan of one subject or section for the test fills those that are missing."""
    only = plan.groupBy("test_id").agg(
        F.when(F.count_distinct("subject") == 1, F.min("subject")).alias("only_subject"), F.when(F.count_distinct("section_name") == 1, F.min("section_name")).alias("only_section")
    )
    rows = items.join(only, "test_id", "left")
    return rows.select(
        "id", "pos", "test_id", field(F.col("item"), "question_number", "int").alias("question_number"), filled_or(field(F.col("item"), "subject"), filled_or(F.col("only_subject"), "General")).alias("subject"),
        filled_or(field(F.col("item"), "section_name"), filled_or(F.col("only_section"), "Main")).alias("section_name"), field(F.col("item"), "question_text").alias("question_text"),
        field(F.col("item"), "correct_answer").alias("correct_answer"), field(F.col("item"), "question_type").alias("question_type"), page_number(F.col("item"), F.col("first_page")).alias("page_number"),
    )


def options_to_map(options: Column) -> Column:
    """A list of options under the letters A, B, ..., without their own labels."""
    entry = lambda v, i: F.struct(F.char(F.lit(65) + i).alias("k"), python_strip(F.regexp_replace(v, r"(?U)^\(?[A-Z]\)[\s.]*", "")).alias("v"))
    return F.map_from_entries(F.transform(options, entry))


def normalize_bbox(box: Column) -> Column:
    """struct<x0, y0, x1, y1> of a JSON box: four keys, a nested bbox, or a list of four; else null."""
    v = F.try_parse_json(box)

    def of(prefix: str) -> Column:
        number = lambda p: F.try_variant_get(v, prefix + p, "double")
        named = F.when(number(".x0").isNotNull() & number(".y0").isNotNull() & number(".x1").isNotNull() & number(".y1").isNotNull(), F.struct(*(number(f".{c}").alias(c) for c in ("x0", "y0", "x1", "y1"))))
        four = F.size(F.try_variant_get(v, prefix, "array<variant>")) == 4
        full = four & number("[0]").isNotNull() & number("[1]").isNotNull() & number("[2]").isNotNull() & number("[3]").isNotNull()
        return F.coalesce(named, F.when(full, F.struct(*(number(f"[{i}]").alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))))))

    return F.coalesce(of("$"), of("$.bbox"))


def page_batches(pages: DataFrame) -> DataFrame:
    """Pages (doc, page, text) by twos, each cut to 12,000 characters between markers; a batch has two pages at most."""
    clean = pages.select("doc", "page", F.substring(clean_page_text(F.col("text")), 1, PAGE_CHARS).alias("text")).where("text <> ''")
    mark = lambda what: F.format_string(PAGE_MARKER.format(what), "page")
    block = F.concat_ws("\n", mark("START"), "text", mark("END"))
    batch = F.floor((F.col("page") - 1) / PAGES_PER_BATCH)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", block.alias("block")))), lambda x: x["block"]), "\n\n")
    return clean.groupBy("doc", batch.alias("batch")).agg(joined.alias("text"), F.count("*").alias("pages"))


def explode_blueprint(configs: DataFrame) -> DataFrame:
    """One row per section of each configuration (id, config_data): range from 1 on, count, type and marks."""
    c = configs.select("id", F.from_json("config_data", CONFIG).alias("c"))
    s = c.select("id", F.explode("c.subjects").alias("subject", "conf")).select("id", "subject", F.explode("conf.sections").alias("section_name", "s"))
    start = F.greatest(F.lit(1), F.coalesce("s.start_q", F.lit(1)))
    rows = s.select("id", title_case(python_strip(F.col("subject"))).alias("subject"), "section_name", start.alias("start_q"), F.greatest(start, F.coalesce("s.end_q", F.lit(20))).alias("end_q"), F.col("s.type").alias("type"), F.coalesce("s.marks", F.lit(4.0)).alias("pos_mark"), F.coalesce("s.negative_marks", F.lit(-1.0)).alias("neg_mark"))
    return rows.withColumn("q_count", F.col("end_q") - F.col("start_q") + 1)


def split_on_marker(rows: DataFrame, token: str) -> DataFrame:
    """Segments of texts that hold the marker and have a page and a box; other texts are one segment."""
    can = F.col("text").contains(token) & F.col("page").isNotNull() & F.col("has_box")
    parts = F.when(F.coalesce(can, F.lit(False)), F.split("text", "\\Q" + token + "\\E")).otherwise(F.array("text"))
    return rows.select("id", F.posexplode(parts).alias("segment", "part"))
