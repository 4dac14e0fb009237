"""Flows from documents to records with a model in them, and what is built from records: training examples, test sets, result rows.

A model is any function that takes a table with a column prompt and returns it with a column answer, null for a call that
failed: answers kept in a table (answers_of), or a Python function on batches of prompts (called)."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.functions import jsontext, text
from refloom.functions.authors import parsed_authors
from refloom.operators.records import hash_key, merged_batches

Model = Callable[[DataFrame], DataFrame]


def answers_of(table: DataFrame) -> Model:
    """A model whose answers stand in a table of prompt and answer; of prompts that repeat there, the least answer."""
    known = table.groupBy(F.sha2("prompt", 256).alias("__prompt")).agg(F.min("answer").alias("answer"))
    return lambda rows: rows.withColumn("__prompt", F.sha2("prompt", 256)).join(known, "__prompt", "left").drop("__prompt")


def called(complete: Callable[[list[str]], Iterable[str | None]], batch: int = 50) -> Model:
    """A model that calls a function with lists of at most `batch` prompts, on the executors. A call that raises gives nulls for its
    list. A task that is run again calls again, so the function should keep what it was paid for."""
    @F.pandas_udf("string")
    def answer(prompts: pd.Series) -> pd.Series:
        out: list[str | None] = []
        for start in range(0, len(prompts), batch):
            part = prompts.iloc[start : start + batch].tolist()
            try:
                found = list(complete(part))
            except Exception:  # noqa: BLE001  whatever a service raises is a failed call
                found = [None] * len(part)
            out += found if len(found) == len(part) else [None] * len(part)
        return pd.Series(out, index=prompts.index, dtype="object")

    return lambda rows: rows.withColumn("answer", answer("prompt"))


def _asked(rows: DataFrame, model: Model, template: str, c: str) -> DataFrame:
    return model(rows.withColumn("prompt", text.filled_prompt(F.lit(template), input_text=F.col(c)))).drop("prompt")


def _no_lines() -> Column:
    return F.array().cast("array<string>")


def extracted_lines(docs: DataFrame, model: Model, template: str) -> DataFrame:
    """docs: doc_id, text. doc_id, lines (trimmed, none empty), error."""
    answered = _asked(docs.select("doc_id", "text"), model, template, "text")
    return answered.select("doc_id", F.coalesce(text.response_lines(F.col("answer")), _no_lines()).alias("lines"), F.when(F.col("answer").isNull(), "call failed").alias("error"))


def _pages(docs: DataFrame, extractor: str | None) -> DataFrame:
    pages = docs.select("doc_id", F.posexplode(text.split_pages(F.col("text"), extractor)).alias("page", "text"))
    return pages.where(F.trim("text") != "")


def lines_by_page(docs: DataFrame, model: Model, template: str, extractor: str | None = None) -> DataFrame:
    """doc_id, lines, n_pages, n_failed, error: every page that isn't blank is asked for by itself; lines come in the order of pages. Failed
    pages are left out; if all fail, that is the error. A document without pages has no lines."""
    answered = _asked(_pages(docs, extractor), model, template, "text")
    lines = F.coalesce(text.response_lines(F.col("answer")), _no_lines())
    gathered = answered.groupBy("doc_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("page", lines.alias("lines")))), lambda x: x["lines"])).alias("lines"), F.count(F.lit(1)).alias("n_pages"),
        F.count_if(F.col("answer").isNull()).alias("n_failed"),
    )
    joined = docs.select("doc_id").join(gathered, "doc_id", "left")
    failed = F.when((F.col("n_pages") > 0) & (F.col("n_failed") == F.col("n_pages")), "every page failed")
    return joined.select("doc_id", F.coalesce("lines", _no_lines()).alias("lines"), F.coalesce("n_pages", F.lit(0)).alias("n_pages"), F.coalesce("n_failed", F.lit(0)).alias("n_failed"), failed.alias("error"))


def lines_of_sections(docs: DataFrame, sections: DataFrame, model: Model, template: str) -> DataFrame:
    """doc_id, lines, error: of the document's section (sections: doc_id, section), or of the whole text where there is none or
    where its section gave no lines."""
    joined = docs.select("doc_id", "text").join(sections.select("doc_id", "section"), "doc_id", "left")
    part = F.when(F.trim(F.coalesce("section", F.lit(""))) != "", F.col("section")).otherwise(F.col("text"))
    first = extracted_lines(joined.select("doc_id", part.alias("text")), model, template)
    again = extracted_lines(docs.join(first.where(F.size("lines") == 0), "doc_id", "left_semi"), model, template)
    both = first.join(again.select("doc_id", F.col("lines").alias("more"), F.col("error").alias("more_error")), "doc_id", "left")
    return both.select("doc_id", F.when(F.size("lines") > 0, F.col("lines")).otherwise(F.coalesce("more", "lines")).alias("lines"), F.when(F.size("lines") == 0, F.coalesce("more_error", "error")).alias("error"))


def _records(answer: Column, strict: bool) -> Column:
    """Records of an answer as JSON texts; null if it does not parse. Not strict: an empty list under a known key counts as one record,
    the answer itself."""
    found = jsontext.response_records(answer)
    if not strict:
        found = F.when((F.size(found) == 0) & ~F.trim(answer).startswith("["), F.array(jsontext.parsed(answer))).otherwise(found)
    return F.transform(found, lambda r: F.to_json(r))


def parsed_lines(lines: DataFrame, model: Model, template: str) -> DataFrame:
    """lines: doc_id, lines. doc_id, records (JSON texts), error: 'no JSON', or 'no records' of lines that aren't empty."""
    asked = lines.select("doc_id", F.size("lines").alias("n"), F.array_join("lines", "\n").alias("text"))
    answered = _asked(asked, model, template, "text").withColumn("records", _records(F.col("answer"), strict=True))
    error = F.when(F.col("answer").isNull(), "call failed").when(F.col("records").isNull(), "no JSON").when((F.size("records") == 0) & (F.col("n") > 0), "no records")
    return answered.select("doc_id", F.coalesce("records", _no_lines()).alias("records"), error.alias("error"))


def one_step(docs: DataFrame, model: Model, template: str) -> DataFrame:
    """doc_id, records, error: one answer for the whole text."""
    answered = _asked(docs.select("doc_id", "text"), model, template, "text").withColumn("records", _records(F.col("answer"), strict=False))
    return answered.select("doc_id", F.coalesce("records", _no_lines()).alias("records"), F.when(F.col("answer").isNull(), "call failed").when(F.col("records").isNull(), "no JSON").alias("error"))


def two_step(docs: DataFrame, model: Model, extraction: str, parsing: str) -> DataFrame:
    """doc_id, records, error: lines of the whole text, then their records."""
    return _then(extracted_lines(docs, model, extraction), model, parsing)


def semantic_one_step(docs: DataFrame, sections: DataFrame, model: Model, template: str) -> DataFrame:
    """doc_id, records, error: one answer for the document's section, or for its text where it has none."""
    joined = docs.select("doc_id", "text").join(sections.select("doc_id", "section"), "doc_id", "left")
    part = F.when(F.trim(F.coalesce("section", F.lit(""))) != "", F.col("section")).otherwise(F.col("text"))
    return one_step(joined.select("doc_id", part.alias("text")), model, template)


def one_step_by_page(docs: DataFrame, model: Model, template: str, extractor: str | None = None) -> DataFrame:
    """doc_id, records, n_pages, n_failed, error: one answer a page, records in the order of pages; failed pages are left out."""
    answered = _asked(_pages(docs, extractor), model, template, "text").withColumn("records", _records(F.col("answer"), strict=False))
    gathered = answered.groupBy("doc_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("page", F.coalesce("records", _no_lines()).alias("records")))), lambda x: x["records"])).alias("records"),
        F.count(F.lit(1)).alias("n_pages"), F.count_if(F.col("records").isNull()).alias("n_failed"),
    )
    failed = F.when((F.col("n_pages") > 0) & (F.col("n_failed") == F.col("n_pages")), "every page failed")
    return docs.select("doc_id").join(gathered, "doc_id", "left").select("doc_id", F.coalesce("records", _no_lines()).alias("records"), F.coalesce("n_pages", F.lit(0)).alias("n_pages"), F.coalesce("n_failed", F.lit(0)).alias("n_failed"), failed.alias("error"))


def two_step_by_page(docs: DataFrame, model: Model, extraction: str, parsing: str, extractor: str | None = None) -> DataFrame:
    """doc_id, records, error: lines page by page, then the records of all of them."""
    return _then(lines_by_page(docs, model, extraction, extractor), model, parsing)


def _then(lines: DataFrame, model: Model, parsing: str) -> DataFrame:
    found = parsed_lines(lines, model, parsing).withColumnRenamed("error", "__error")
    return found.join(lines.select("doc_id", "error"), "doc_id").select("doc_id", "records", F.coalesce("error", "__error").alias("error"))


def realigned(tasks: DataFrame) -> DataFrame:
    """tasks: task_id, references (array), answer. One row for each reference: task_id, pos, reference, record (JSON, '{}' where the answer
    has fewer), failed: whether the answer is empty, no JSON, or neither a list nor an object with a list of references."""
    v = F.try_parse_json("answer")
    listed = F.try_variant_get(v, "$", "array<variant>")
    keyed = F.try_variant_get(v, "$.references", "array<variant>")
    empty = F.coalesce(F.trim("answer") == "", F.lit(True))
    with_records = tasks.withColumn("__records", F.coalesce(listed, keyed)).withColumn("failed", empty | v.isNull() | (F.col("__records").isNull() & (F.trim("answer") != "{}")))
    rows = with_records.select("task_id", "failed", "__records", F.posexplode("references").alias("pos", "reference"))
    return rows.select("task_id", "pos", "reference", F.coalesce(F.to_json(F.get("__records", F.col("pos"))), F.lit("{}")).alias("record"), "failed")


def reference_of_row(parsed: Column, original: Column) -> Column:
    """struct(title, authors, date, journal, doi) of a variant of parsed fields, under either of their names; without any, the first 200
    characters of the text as title."""
    of = lambda *names: F.coalesce(*(F.try_variant_get(parsed, f"$.{n}", "string") for n in names))
    authors = F.coalesce(F.try_variant_get(parsed, "$.authors", "array<string>"), F.when(of("author").isNotNull(), F.array(of("author"))))
    given = parsed.isNotNull() & ~F.coalesce(F.schema_of_variant(parsed) == "OBJECT<>", F.lit(False))
    return F.when(given, F.struct(of("full_title", "title").alias("title"), authors.alias("authors"), of("publication_date", "year").alias("date"), of("journal_title").alias("journal"), of("doi").alias("doi"))).otherwise(
        F.struct(F.substring(original, 1, 200).alias("title"), F.lit(None).cast("array<string>").alias("authors"), *(F.lit(None).cast("string").alias(k) for k in ("date", "journal", "doi")))
    )


#: Fields of a training record, and the tags they come from in order of preference.
TRAINING_FIELDS = {
    "full_title": ["title"], "journal_title": ["journal", "publicationnumber"], "volume": ["volume"], "issue": ["issue"], "pages": ["pagination"], "publisher": ["publisher"], "publication_place": ["publicationplace"],
}


def training_record(tags: Column, original: Column) -> Column:
    """struct(json, reason) of a map of tags: the record with its authors read, and 'valid' or the first rule that it breaks: an author that
    could not be read, or no author though the text begins with a name."""
    of = lambda *names: F.trim(F.coalesce(*(F.element_at(tags, n) for n in names), F.lit("")))
    authors = parsed_authors(F.coalesce(F.element_at(tags, "author"), F.lit("")))
    shown = F.transform(authors, lambda a: F.struct(*(F.coalesce(a[n], F.lit("")).alias(n) for n in ("first_name", "middle_name", "surname"))))
    record = F.struct(shown.alias("authors"), *(of(*names).alias(k) for k, names in TRAINING_FIELDS.items()), text.clean_date(of("year")).alias("publication_date"))
    unread = F.exists(authors, lambda a: a["kind"] == "str")
    nobody = F.size(authors) == 0
    reason = F.when(unread, "unparsed_author_string").when(nobody & F.trim(original).rlike(r"^[A-Z][a-z]+[\s,.]|^[A-Z]\."), "missing_obvious_author").otherwise("valid")
    return F.struct(F.to_json(record).alias("json"), reason.alias("reason"))


def tags_reason(tags: Column) -> Column:
    """'valid', or the first rule that a tagged reference breaks."""
    of = lambda n: F.trim(F.coalesce(F.element_at(tags, n), F.lit("")))
    return (
        F.when(F.map_contains_key(tags, "abbreviation") | F.map_contains_key(tags, "numbered_ref"), "has_abbreviation_or_numbered_ref_tag")
        .when(F.length(of("title")) < 5, "missing_or_short_title").when((of("author") == "") & (of("year") == ""), "missing_author_and_year").otherwise("valid")
    )


def reason_counts(df: DataFrame, reason: Column) -> DataFrame:
    """reason, n."""
    return df.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def training_examples(refs: DataFrame, group: str, key: str, size: int, least: int, system: str) -> DataFrame:
    """refs: group, key, text, json, reason. Chat examples: mode single, one for each valid reference; mode grouped, one for each batch of
    `size` references of a group (a last one of fewer than `least` joins the one before), if all of its references are valid."""
    listed = lambda x: F.concat(F.lit('{"references":['), F.array_join(x, ","), F.lit("]}"))
    single = refs.where("reason = 'valid'").select(F.lit("single").alias("mode"), F.col(group).cast("string").alias("part"), F.col(key).cast("long").alias("first_key"), F.lit(1).cast("long").alias("n"), text.chat(F.lit(system), F.col("text"), listed(F.array("json"))).alias("messages"))
    gathered = merged_batches(refs, group, key, size, least).groupBy(group, "batch").agg(F.bool_and(F.col("reason") == "valid").alias("ok"), F.array_sort(F.collect_list(F.struct(key, "text", "json"))).alias("x")).where("ok")
    grouped = gathered.select(F.lit("grouped").alias("mode"), F.col(group).cast("string").alias("part"), F.get("x", F.lit(0))[key].cast("long").alias("first_key"), F.size("x").cast("long").alias("n"),
                              text.chat(F.lit(system), F.array_join(F.transform("x", lambda r: r["text"]), "\n"), listed(F.transform("x", lambda r: r["json"]))).alias("messages"))
    return single.unionByName(grouped)


def sampled_test_set(sources: dict[str, DataFrame], n: int, seed: int = 42) -> DataFrame:
    """ref_id, source, text: n rows of each source (key, text) in a hash order, numbered by source."""
    parts = []
    for name, df in sorted(sources.items()):
        taken = df.orderBy(hash_key(F.col("key"), seed=seed), "key").limit(n)  # no more than n rows of a source
        parts.append(taken.select(F.concat(F.lit(name + "_"), F.col("key").cast("string")).alias("ref_id"), F.lit(name).alias("source"), "text"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def linking_rows(results: DataFrame, indexes: list[str]) -> DataFrame:
    """results: ref_id, text, results (map of index to struct of ids, title, similarity, is_match). One row for each reference and index:
    ref_id, index, matched_id ('Not Found' without one), matched_doi, matched_title, is_match."""
    found = results.select("ref_id", F.explode(F.array(*(F.lit(i) for i in indexes))).alias("index"), "results").withColumn("r", F.element_at("results", F.col("index")))
    return found.select(
        "ref_id", "index", F.coalesce(F.element_at("r.ids", F.concat("index", F.lit("_id"))), F.lit("Not Found")).alias("matched_id"), F.coalesce(F.element_at("r.ids", F.lit("doi")), F.lit("")).alias("matched_doi"),
        F.col("r.title").alias("matched_title"), F.coalesce("r.is_match", F.col("r.similarity") >= 90, F.lit(False)).alias("is_match"),
    )


def with_references(docs: DataFrame, found: DataFrame, field: str = "references") -> DataFrame:
    """docs with the field replaced by found's (doc_id, field), where it has the document; all else as it is."""
    new = found.select("doc_id", F.col(field).alias("__new"), F.lit(True).alias("__has"))
    return docs.join(new, "doc_id", "left").withColumn(field, F.when(F.col("__has"), F.col("__new")).otherwise(F.col(field))).drop("__new", "__has")


def graph_matches(edges: DataFrame, targets: DataFrame, least: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """edges: pub_id, ref_id, target_id (null without one); targets: target_id, confidence. (matched: pub_id, ref_id, target_id, confidence
    of targets of at least that confidence; unmatched: pub_id, ref_id of references without any such target)."""
    good = targets.where(F.col("confidence") >= least)
    matched = edges.join(good, "target_id").select("pub_id", "ref_id", "target_id", "confidence")
    return matched, edges.select("pub_id", "ref_id").distinct().join(matched.select("ref_id").distinct(), "ref_id", "left_anti").select("pub_id", "ref_id")
