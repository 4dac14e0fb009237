"""Predictions against gold: counts, precision, recall and F1, and the optimal one-to-one alignment."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.functions.similarity import edit_distance, indel_ratio


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def with_prf(df: DataFrame, matches: str = "matches", preds: str = "preds", labels: str = "labels") -> DataFrame:
    """Adds precision, recall and f1 to four digits; 0 where a denominator is."""
    m, p, n = F.col(matches), F.col(preds), F.col(labels)
    return df.withColumns({"precision": F.round(share(m, p), 4), "recall": F.round(share(m, n), 4), "f1": F.round(share(2 * m, p + n), 4)})


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of the least total cost, one for each row or column of the shorter side: shortest augmenting
    paths with potentials."""
    cost = np.asarray(cost, dtype=float)
    if not cost.size:
        return []
    if cost.shape[0] > cost.shape[1]:
        return sorted((i, j) for j, i in assignment(cost.T))
    n, m = cost.shape
    if n == 1:
        return [(0, int(cost[0].argmin()))]
    rows, columns = np.zeros(n + 1), np.zeros(m + 1)
    owner, came = np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], at = i, 0
        least, done = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            done[at] = True
            slack = cost[owner[at] - 1] - rows[owner[at]] - columns[1:]
            better = ~done[1:] & (slack < least[1:])
            least[1:][better], came[1:][better] = slack[better], at
            free = np.where(done[1:], np.inf, least[1:])
            step = free.min()
            following = int(free.argmin()) + 1
            rows[owner[done]] += step
            columns[done] -= step
            least[~done] -= step
            at = following
            if not owner[at]:
                break
        while at:
            owner[at], at = owner[came[at]], came[at]
    return sorted((int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j])


#: How likeness of two whole references is measured.
STRING_MODES = {
    "fuzzy": lambda a, b: indel_ratio(a, b) / 100,
    "levenshtein": lambda a, b: 1 - edit_distance(a, b) / max(len(a), len(b), 1),
}


def align_strings(pairs: DataFrame, threshold: float = 0.8, mode: str = "fuzzy") -> DataFrame:
    """pairs: doc_id, gold (array), predicted (array). doc_id, matches, preds, labels, precision, recall, f1, similarity:
    one-to-one pairs of the highest total likeness, those that reach the threshold counted, and the mean likeness of these.
    Strings are trimmed and blank ones left out; a document without any on both sides has 1 everywhere. One document's arrays
    are held at a time."""
    if mode not in STRING_MODES:
        raise ValueError(f"mode is {mode}, not one of {sorted(STRING_MODES)}")
    alike = STRING_MODES[mode]
    given = lambda xs: [x.strip() for x in (xs if xs is not None else ()) if x is not None and x.strip()]

    def run(parts):
        for part in parts:
            out = []
            for doc_id, gold, predicted in zip(part["doc_id"], part["gold"], part["predicted"], strict=True):
                gold, predicted = given(gold), given(predicted)
                score = np.array([[alike(g, p) for p in predicted] for g in gold]).reshape(len(gold), len(predicted))
                kept = [score[i, j] for i, j in assignment(-score) if score[i, j] >= threshold]
                n, m, k = len(predicted), len(gold), len(kept)
                rates = (k / n, k / m, 2 * k / (n + m), float(np.mean(kept)) if kept else 0.0) if n and m else (float(n == m),) * 4
                out.append((doc_id, k, n, m, *(round(r, 4) for r in rates)))
            yield pd.DataFrame(out, columns=["doc_id", "matches", "preds", "labels", "precision", "recall", "f1", "similarity"])

    return pairs.select("doc_id", "gold", "predicted").mapInPandas(run, "doc_id long, matches long, preds long, labels long, precision double, recall double, f1 double, similarity double")


#: How values are compared: equal, alike from a threshold up, or by their likeness itself.
MODES = ("exact", "fuzzy", "soft_fuzzy")


def value_match(a: str | None, b: str | None, mode: str, threshold: float) -> float:
    """0 to 1; values are trimmed and compared in lower case, null matches nothing."""
    if a is None or b is None:
        return 0.0
    a, b = a.strip().lower(), b.strip().lower()
    if mode == "exact":
        return float(a == b)
    likeness = indel_ratio(a, b) / 100
    return likeness if mode == "soft_fuzzy" else float(likeness >= threshold)


#: Fields in which two persons are compared.
PERSON_FIELDS = ("first_name", "middle_name", "surname", "role_name")


def _shown(a: dict) -> str:
    """An agent as text: 'First Middle Surname', or the role alone; an organisation's name; a text as it is."""
    if a["kind"] != "person":
        return a["name" if a["kind"] == "org" else "literal"] or ""
    return " ".join(a[f] for f in PERSON_FIELDS[:3] if a[f]) or a["role_name"] or ""


def agent_match(a: dict | None, b: dict | None, mode: str, threshold: float) -> float:
    """0 to 1. Two persons by the fields that either has: their mean in soft mode, else all of them or nothing. Agents of one other
    kind by name; of different kinds as texts, a person against a text also as 'Surname, First Middle', the better of both."""
    if a is None or b is None:
        return 0.0
    if a["kind"] == b["kind"] == "person":
        each = [value_match(a[f], b[f], mode, threshold) for f in PERSON_FIELDS if a[f] is not None or b[f] is not None]
        return (sum(each) / len(each) if mode == "soft_fuzzy" else float(all(each))) if each else 1.0
    best = value_match(_shown(a), _shown(b), mode, threshold)
    if {a["kind"], b["kind"]} == {"person", "str"}:
        person, other = (a, b) if a["kind"] == "person" else (b, a)
        if person["surname"] and person["first_name"]:
            turned = f"{person['surname']}, {' '.join(person[f] for f in PERSON_FIELDS[:2] if person[f])}"
            best = max(best, value_match(turned, _shown(other), mode, threshold))
    return best


def matched(a, b, mode: str, threshold: float) -> float:
    """agent_match of agents, value_match of texts."""
    return (agent_match if isinstance(a, dict) or isinstance(b, dict) else value_match)(a, b, mode, threshold)


def field_counts(predicted: list | None, gold: list | None, mode: str, threshold: float) -> tuple[float, int, int]:
    """Matches, predictions and labels of one field: lists of one length by position, others by the best assignment. A match
    counts whole outside soft mode."""
    if not predicted or not gold:
        return 0.0, len(predicted or ()), len(gold or ())
    if len(predicted) == len(gold):
        total = sum(matched(p, g, mode, threshold) for p, g in zip(predicted, gold))
    else:
        score = np.array([[matched(p, g, mode, threshold) for g in gold] for p in predicted])
        total = sum(score[i, j] for i, j in assignment(-score))
    return float(total), len(predicted), len(gold)


def align_records(pairs: DataFrame, fields: list[str], mode: str = "exact", threshold: float = 0.8) -> DataFrame:
    """pairs: doc_id, gold, predicted, both arrays of map<string, array<string>> (a scalar is a list of one), or of structs of such a
    map, `texts`, and of `agents`, a map of arrays of agents (refloom.functions.authors.AGENT). Records are aligned one
    to one so that the sum of their F1 is highest; those left over count with their own fields. One row for each document
    and field: doc_id, field, matches, preds, labels, and doc_f1, the mean F1 of the document's records, those left over at 0;
    1 where there are none at all. One document's records are held at a time."""
    if mode not in MODES:
        raise ValueError(f"mode is {mode}, not one of {MODES}")

    def stats(p: dict, g: dict) -> list[tuple[float, int, int]]:
        return [field_counts(p.get(f), g.get(f), mode, threshold) for f in fields]

    def f1(counts: list[tuple[float, int, int]]) -> float:
        size = sum(p + n for _, p, n in counts)
        return 2 * sum(m for m, _, _ in counts) / size if size else 0.0

    def record(r) -> dict:
        items = [] if r is None else list(r.items() if isinstance(r, dict) else r)
        if {k for k, _ in items} == {"texts", "agents"}:
            items = [x for _, part in items if part is not None for x in (part.items() if isinstance(part, dict) else part)]
        return {k: [x.asDict() if hasattr(x, "asDict") else x for x in v] for k, v in items if v is not None}

    def records(rows) -> list[dict]:
        return [record(r.asDict() if hasattr(r, "asDict") else r) for r in (rows if rows is not None else ())]

    def run(parts):
        for part in parts:
            out = []
            for doc_id, gold, predicted in zip(part["doc_id"], part["gold"], part["predicted"], strict=True):
                gold, predicted = records(gold), records(predicted)
                counts = [[stats(p, g) for g in gold] for p in predicted]
                score = np.array([[f1(c) for c in row] for row in counts]).reshape(len(predicted), len(gold))
                chosen = assignment(-score)
                alone = [stats(predicted[i], {}) for i in set(range(len(predicted))) - {i for i, _ in chosen}]
                alone += [stats({}, gold[j]) for j in set(range(len(gold))) - {j for _, j in chosen}]
                total = [tuple(map(sum, zip(*of))) for of in zip(*(counts[i][j] for i, j in chosen), *alone)] or [(0.0, 0, 0)] * len(fields)
                n = max(len(gold), len(predicted))
                mean = float(sum(score[c] for c in chosen)) / n if n else 1.0
                out += [(doc_id, f, float(m), p, g, mean) for f, (m, p, g) in zip(fields, total, strict=True)]
            yield pd.DataFrame(out, columns=["doc_id", "field", "matches", "preds", "labels", "doc_f1"])

    return pairs.select("doc_id", "gold", "predicted").mapInPandas(run, "doc_id long, field string, matches double, preds long, labels long, doc_f1 double")


def per_field(aligned: DataFrame) -> DataFrame:
    """field, matches, preds, labels, precision, recall, f1 over all documents."""
    return with_prf(aligned.groupBy("field").agg(*(F.sum(c).alias(c) for c in ("matches", "preds", "labels"))))


def overall(aligned: DataFrame) -> DataFrame:
    """One row: precision, recall and f1 over all fields, and macro_f1, the mean over documents."""
    documents = aligned.groupBy("doc_id").agg(*(F.sum(c).alias(c) for c in ("matches", "preds", "labels")), F.first("doc_f1").alias("doc_f1"))
    return with_prf(documents.agg(*(F.sum(c).alias(c) for c in ("matches", "preds", "labels")), F.round(F.avg("doc_f1"), 4).alias("macro_f1")))


def field_means(aligned: DataFrame) -> DataFrame:
    """field, n_docs, precision, recall, f1: means over the documents that have the field in gold or predictions."""
    each = with_prf(aligned.where("preds + labels > 0"))
    return each.groupBy("field").agg(F.count(F.lit(1)).alias("n_docs"), *(F.round(F.avg(c), 4).alias(c) for c in ("precision", "recall", "f1")))


def report(pairs: DataFrame, fields: list[str], focus: list[str], mode: str = "exact", threshold: float = 0.8) -> DataFrame:
    """One row: overall_ and focused_precision, _recall, _micro_f1 and _macro_f1, of all fields and of those in focus, each by an alignment
    of its own; and per_field, a map of the fields in focus to structs of precision, recall and f1, 0 for fields nobody has."""
    def scores(aligned: DataFrame, name: str) -> DataFrame:
        return overall(aligned).select(*(F.col(c).alias(f"{name}_{as_}") for c, as_ in (("precision", "precision"), ("recall", "recall"), ("f1", "micro_f1"), ("macro_f1", "macro_f1"))))

    focused = align_records(pairs, focus, mode, threshold)
    by_field = per_field(focused).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", F.struct("precision", "recall", "f1"))))).alias("per_field"))
    # three tables of one row
    return scores(align_records(pairs, fields, mode, threshold), "overall").crossJoin(scores(focused, "focused")).crossJoin(by_field)


def record_score(title: Column, place: Column, year: Column, authors: Column) -> Column:
    """The mean of a record's four likenesses, null ones as 0."""
    return sum(F.coalesce(c.cast("double"), F.lit(0.0)) for c in (title, place, year, authors)) / 4


def unless_all_failed(df: DataFrame, failed: Column) -> DataFrame:
    """df, or an error where it has rows and all of them have failed: such a run has no scores, rather than zeros. Checked when df is read."""
    counts = df.agg(F.count_if(failed).alias("__failed"), F.count(F.lit(1)).alias("__all"))
    checked = df.crossJoin(F.broadcast(counts))  # one row
    return checked.withColumn("__ok", F.when((F.col("__all") > 0) & (F.col("__failed") == F.col("__all")), F.raise_error(F.lit("all calls failed")).cast("boolean")).otherwise(F.lit(True))).where("__ok").drop("__failed", "__all", "__ok")
