"""Reports of a run: Markdown, JSON, and the ordered event rows of a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veracol.operators.risk import RISKS, report_level


def final_risks(results: DataFrame, key: str = "doc_id") -> DataFrame:
    """The risks of each document's last sentence; warnings (negative idx) have none."""
    return results.where("idx >= 0").groupBy(key).agg(*[F.max_by(r, "idx").alias(r) for r in RISKS])


def live_risks(results: DataFrame, key: str = "doc_id") -> DataFrame:
    """The last risk that is not null by order of arrival, as a whole number."""
    return results.groupBy(key).agg(*[F.round(F.max_by(r, F.when(F.col(r).isNotNull() & (F.col("idx") >= 0), F.col("idx")))).cast("int").alias(r) for r in RISKS])


def _joined(where: Column, idx: Column, line: Column) -> Column:
    """The lines of a group's rows that meet a condition, by idx; null without any."""
    found = F.collect_list(F.when(where, F.struct(idx.alias("idx"), line.alias("line"))))
    return F.when(F.count_if(where) > 0, F.array_join(F.transform(F.sort_array(found), lambda x: x["line"]), "\n"))


def markdown(results: DataFrame, audits: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, report: risk table, integrity warnings, flagged sentences, citation audits, evidence index.

    results: idx, text, status, issue_type, severity, ppl and the risks; audits: idx, cite_key, title, status, evidence.
    """
    # One pass over the results, which may be long to compute.
    named = F.concat(F.lit("`"), F.coalesce("issue_type", F.lit("")), F.lit("` ("), F.coalesce("severity", F.lit("")), F.lit(")"))
    warned = F.concat(F.lit("- "), named, F.lit(": "), F.col("text"))
    ppl = F.when(F.col("ppl").isNotNull(), F.format_string(", perplexity %.2f", "ppl")).otherwise("")
    flagged = F.concat(F.lit("- "), F.col("idx").cast("string"), F.lit(" "), named, ppl, F.lit(": "), F.col("text"))
    body = F.col("idx") >= 0
    known = results.groupBy(key).agg(
        *[F.max_by(r, F.when(body, F.col("idx"))).alias(r) for r in RISKS],
        F.count_if(body).alias("_n"),
        _joined(F.col("idx") < 0, -F.col("idx"), warned).alias("warnings"),
        _joined(body & (F.col("status") == "flagged"), F.col("idx"), flagged).alias("flagged"),
    )
    row = lambda r: F.format_string(f"| {r} | %.1f%% | %s |", r, report_level(F.col(r)))
    table = F.concat_ws("\n", F.lit("| risk | value | level |"), F.lit("| --- | --- | --- |"), *[row(r) for r in RISKS])
    df = known.where("_n > 0").select(key, table.alias("risk_table"), "warnings", "flagged")
    cut = lambda c, n: F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(F.col(c))
    checked = F.concat_ws(" | ", F.lit("|"), F.col("cite_key"), cut("title", 35), F.col("status"), F.lit("|"))
    quoted = F.concat(F.lit("- ["), F.col("cite_key"), F.lit("] "), cut("evidence", 50))
    every = _joined(F.lit(True), F.col("idx"), checked)
    df = df.join(audits.groupBy(key).agg(every.alias("audits"), _joined(F.col("evidence") != "", F.col("idx"), quoted).alias("evidence")), key, "left")
    section = lambda title, body, none: F.concat(F.lit(f"## {title}\n"), F.coalesce(body, F.lit(none)))
    text = F.concat_ws(
        "\n\n",
        F.lit("# Writing and citation audit"),
        section("1. Document risks", F.col("risk_table"), ""),
        F.when(F.col("warnings").isNotNull(), section("2. Citation integrity", F.col("warnings"), "")),
        section("3. Sentences to revise", F.col("flagged"), "None."),
        F.when(F.col("audits").isNotNull(), section("4. Citation audits", F.col("audits"), "")),
        F.when(F.col("evidence").isNotNull(), section("5. Evidence", F.col("evidence"), "")),
    )
    return df.select(key, text.alias("report"))


def as_json(results: DataFrame, audits: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, report as JSON: results and audits in order, sentences in total, results flagged (warnings too)."""
    gathered = lambda df, by: F.sort_array(F.collect_list(F.struct(by, *[c for c in df.columns if c not in (key, by)])))
    known = results.groupBy(key).agg(F.count_if(F.col("idx") >= 0).alias("total"), F.count_if(F.col("status") == "flagged").alias("flagged_count"), gathered(results, "idx").alias("diagnostics"))
    df = known.join(audits.groupBy(key).agg(gathered(audits, "idx").alias("citations")), key, "left")
    return df.select(key, F.to_json(F.struct("diagnostics", F.coalesce("citations", F.array()).alias("citations"), F.struct("total", "flagged_count").alias("overall_summary"))).alias("report"))


def events(results: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, seq, event, data: init, warnings and results in order, done with the last risks."""
    # One pass: a document's first row brings its opening event along, its last one the closing event.
    body = F.col("idx") >= 0
    doc = Window.partitionBy(key)
    order = doc.orderBy(body, F.abs("idx"))
    rows = results.select(
        key,
        F.to_json(F.struct(*[c for c in results.columns if c != key])).alias("_data"),
        F.row_number().over(order).alias("_n"),
        F.count_if(body).over(doc).alias("sentences"),
        F.when(body & F.lead(F.lit(1)).over(order).isNull(), F.to_json(F.struct(*RISKS))).alias("_done"),
    )
    event = lambda seq, name, data: F.struct(seq.alias("seq"), F.lit(name).alias("event"), data.alias("data"))
    init = F.when(F.col("_n") == 1, event(F.lit(1), "init", F.to_json(F.struct("sentences"))))
    done = F.when(F.col("_done").isNotNull(), event(F.col("_n") + 2, "done", F.col("_done")))
    return rows.select(key, F.explode(F.array_compact(F.array(init, event(F.col("_n") + 1, "result", F.col("_data")), done))).alias("_e")).select(key, "_e.*")
