"""Unique numbers from occurrences, classification, and rankings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.phone import dedupe_key, status_rank
from lodestar.functions.text import either, strip
from lodestar.storage import stored

TITLES, CONTEXTS, HEADINGS = 12, 8, 8

# Departments by keywords; the first that matches counts.
RULES = (
    ("Emergency", ("emergency", "911", "crisis")),
    ("Campus Safety", ("campus safety", "public safety", "police", "security dispatch")),
    ("Admissions", ("admissions", "enrollment", "prospective student")),
    ("Registrar", ("registrar", "transcript", "records office")),
    ("Financial Aid", ("financial aid", "fafsa", "scholarships office")),
    ("Student Services", ("student services", "student affairs", "dean of students")),
    ("IT Support", ("help desk", "itsupport", "it support", "technology services", "information technology")),
    ("Human Resources", ("human resources", "hr office", "benefits")),
    ("Library", ("library", "circulation desk")),
    ("Athletics", ("athletics", "athletic department", "sports information")),
    ("Faculty", ("faculty", "professor", "instructor")),
    ("Staff", ("staff directory", "staff office", "staff phone", "employee directory")),
    ("Department", ("department of", "school of", "college of", "academic department")),
    ("General Information", ("main office", "switchboard", "information desk", "operator", "general information")),
)
FAX = r"(?i)\bfax(?:es|imile)?\b"
VOICE = r"(?i)\b(?:voice|phone|tel|telephone|call|office line)\b"


def ordered_list(rows: DataFrame, keys: list[str], value: Column, name: str, limit: int | None = None) -> DataFrame:
    """For each key the distinct trimmed values that aren't blank, in the order of seq, at most limit of them.

    Values are made distinct before they are gathered, so a key's list holds what differs alone."""
    once = rows.select(*keys, strip(value).alias("v"), "seq").where("v <> ''").groupBy(*keys, "v").agg(F.min("seq").alias("seq"))
    if limit:
        from pyspark.sql.window import Window

        once = once.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("seq"))).where(F.col("k") <= limit)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("seq", "v"))), lambda x: x["v"])
    return once.groupBy(*keys).agg(listed.alias(name))


def unique_phones(occurrences: DataFrame) -> DataFrame:
    """One row for each number and extension. occurrences: with seq, which orders them.

    The row that stands for a number is that with the best status, then with an international form, then with the longest
    context, then the first."""
    key = dedupe_key(F.col("e164_phone"), F.col("normalized_phone"), F.col("extension"), F.col("raw_phone"))
    rows = occurrences.withColumn("key", key).withColumn("page", either(F.col("final_url"), F.col("source_url")))
    has_e164 = F.coalesce(F.col("e164_phone") != "", F.lit(False)).cast("int")
    rank = F.struct(-status_rank(F.col("validation_status")), -has_e164, -F.char_length(F.coalesce("context", F.lit(""))), F.col("seq"))
    best = ("normalized_phone", "e164_phone", "national_format", "extension", "country_code", "validation_status")
    base = rows.groupBy("key").agg(
        F.min_by(F.struct(*best), rank).alias("best"),
        F.count(F.lit(1)).alias("occurrence_count"),
        F.min_by("source_url", "seq").alias("first_seen_url"),
        F.min("seq").alias("seq"),
    )
    lists = (("source_urls", F.col("page"), None), ("source_types", F.col("source_type"), None), ("page_titles", F.col("page_title"), TITLES), ("sample_contexts", F.col("context"), CONTEXTS), ("nearest_headings", F.col("nearest_heading"), HEADINGS))
    for name, value, limit in lists:
        base = base.join(ordered_list(rows, ["key"], value, name, limit), "key", "left")
    empty = F.array().cast("array<string>")
    urls = F.size(F.coalesce("source_urls", empty)).cast("long")
    return base.select(
        "key", *(F.col(f"best.{c}").alias(c) for c in best), "occurrence_count", urls.alias("unique_url_count"), urls.alias("source_count"),
        *(F.coalesce(n, empty).alias(n) for n, _, _ in lists), "first_seen_url", F.lit(None).cast("string").alias("notes"), "seq",
    )


def in_order(phones: DataFrame) -> DataFrame:
    return phones.orderBy(F.desc("occurrence_count"), either(F.col("e164_phone"), F.coalesce("normalized_phone", F.lit(""))), "seq")


def blob() -> Column:
    return F.lower(F.concat_ws(" ", F.array_join("sample_contexts", " "), F.array_join("nearest_headings", " "), F.array_join("page_titles", " ")))


def kind_of(text: Column) -> Column:
    return F.when(text.rlike(FAX), "FAX").when(text.rlike(VOICE), "VOICE").otherwise("UNKNOWN")


def label_of(text: Column, rules: tuple = RULES) -> Column:
    """The label of the first rule with a keyword in text; null if there is none."""
    out = None
    for label, words in rules:
        hit = F.lit(False)
        for w in words:
            hit = hit | text.contains(w)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def classify(phones: DataFrame, rules: tuple = RULES) -> DataFrame:
    """Adds kind, category and where they come from."""
    rows = phones.withColumn("_blob", blob()).withColumn("_label", label_of(F.col("_blob"), rules))
    label = F.coalesce("_label", F.lit("Unknown"))
    first = F.coalesce(F.get("sample_contexts", F.lit(0)), F.lit(""))
    return rows.select(
        *phones.columns,
        kind_of(F.col("_blob")).alias("number_kind"),
        label.alias("category"),
        label.alias("classification"),
        F.when(F.col("_label").isNotNull(), "RULES").otherwise("UNCLASSIFIED").alias("classification_source"),
        F.when(F.col("_label").isNotNull(), 0.7).otherwise(0.2).cast("double").alias("classification_confidence"),
        F.when(first != "", F.concat(label, F.lit(": "), F.substring(first, 1, 240))).otherwise(label).alias("departments_or_context"),
    )


def unlabelled(phones: DataFrame, limit: int = 200) -> DataFrame:
    """The first numbers that no rule labels."""
    return in_order(phones.where("classification_source <> 'RULES'")).limit(limit)


def relabel(phones: DataFrame, ask: Callable[[str], dict] | None, limit: int = 200) -> DataFrame:
    """Asks ask(prompt) about the first numbers that no rule labels; without ask nothing changes, and a failed call changes nothing.

    ask returns classification, number_kind and confidence."""
    if ask is None:
        return phones
    open_ = unlabelled(phones, limit)
    prompt = F.concat_ws("\n", F.concat(F.lit("Number: "), F.coalesce("e164_phone", "normalized_phone", F.lit(""))), F.concat(F.lit("Context: "), F.array_join(F.slice("sample_contexts", 1, 3), " | ")), F.concat(F.lit("Headings: "), F.array_join(F.slice("nearest_headings", 1, 3), " | ")))

    def answers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text in zip(batch["key"], batch["prompt"], strict=True):
                try:
                    got = ask(text)
                    rows.append((key, str(got.get("classification") or "Unknown"), str(got.get("number_kind") or "UNKNOWN").upper(), float(got.get("confidence") or 0.5)))
                except Exception:  # noqa: BLE001  one number's failure isn't the run's
                    continue
            yield pd.DataFrame(rows, columns=["key", "label", "kind", "confidence"])

    asked = stored(open_.select("key", prompt.alias("prompt")), "prompts").repartition(8)
    told = stored(asked.mapInPandas(answers, "key string, label string, kind string, confidence double"), "labels")  # asked once, whatever reads it
    told = told.select("key", F.struct("label", "kind", "confidence").alias("a"))
    rows = phones.join(F.broadcast(told), "key", "left")  # limit rows at most
    there, first = F.col("a").isNotNull(), F.coalesce(F.get("sample_contexts", F.lit(0)), F.lit(""))
    new = {
        "classification": F.col("a.label"),
        "category": F.col("a.label"),
        "number_kind": F.when(F.col("a.kind").isin("VOICE", "FAX", "UNKNOWN"), F.col("a.kind")).otherwise(F.col("number_kind")),
        "classification_source": F.lit("AI"),
        "classification_confidence": F.col("a.confidence"),
        "departments_or_context": F.when(first != "", F.concat(F.col("a.label"), F.lit(": "), F.substring(first, 1, 240))).otherwise(F.col("a.label")),
    }
    return rows.select(*(F.when(there, new[c]).otherwise(F.col(c)).alias(c) if c in new else c for c in phones.columns))


def top_phones(phones: DataFrame, by: str = "occurrence_count", limit: int = 15) -> DataFrame:
    """The limit numbers with most occurrences (or unique_url_count), with their rank."""
    from pyspark.sql.window import Window

    order = [F.desc(by), F.coalesce("e164_phone", F.lit("")), F.desc("occurrence_count"), F.coalesce("normalized_phone", F.lit("")), "key"]
    best = phones.orderBy(*order).limit(limit)
    rank = F.row_number().over(Window.orderBy(*order)).alias("rank")  # over limit rows
    cols = ["e164_phone", "normalized_phone", "occurrence_count", "unique_url_count"]
    return best.select(rank, *cols, *(c for c in ("category",) if c in phones.columns))
