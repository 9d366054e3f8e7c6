"""Explanation texts, model answers and stored JSON as native columns over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Section headings of an explanation and the field each one opens.
HEADINGS = {
    "**Conclusion:**": "conclusion", "**Performance Metrics:**": "performance_metrics",
    "**Key Influencing Features:**": "key_features", "**Model Parameters:**": "model_params",
    "**Additional Notes:**": "additional_notes",
}
# Patterns of the texts.
FEATURE_NAME = r"'([^']+)'\s*\([\d.]+\)"
FEATURE_VALUE = r"'[^']+'\s*\(([\d.]+)\)"
NUMBER = r"[\d.]+"
FENCE = r"^```json\s*|\s*```$"
KEY_JUNK = "[^a-zA-Z0-9 ]"

# marks where a text is cut; taken out of the text first
_CUT = "\x01"


def explanation_lines(df: DataFrame, text: str = "explanation") -> DataFrame:
    """Column ``lines``: the non-empty lines of each text, each with the section it is in.

    The text is cut at its headings into blocks, then each block into lines: one pass, within the row.
    """
    names = "|".join(h.strip("*:") for h in HEADINGS)
    plain = F.concat(F.lit("\n"), F.translate(text, _CUT, ""))
    blocks = F.split(F.regexp_replace(plain, rf"\n[ \t\r]*(\*\*(?:{names}):\*\*)[^\n]*", rf"{_CUT}$1"), _CUT)

    def section_of(block: Column) -> Column:
        c = F.lit(None).cast("string")
        for head, name in HEADINGS.items():
            c = F.when(block.startswith(head), F.lit(name)).otherwise(c)
        return c

    def lines_of(block: Column) -> Column:
        # the first line of a block is its heading, or empty before the first heading
        rest = F.filter(F.split(block, "\n"), lambda x, i: i > 0)
        kept = F.filter(F.transform(rest, lambda x: F.btrim(x, F.lit(" \t\r"))), lambda x: x != "")
        return F.transform(kept, lambda x: F.struct(x.alias("line"), section_of(block).alias("section")))

    return df.withColumn("lines", F.flatten(F.transform(blocks, lines_of)))


def explanation_sections(df: DataFrame) -> DataFrame:
    """Conclusion and notes as text, metrics and parameters as bullet lines, features as lines.

    Feature lines that name no feature belong to the notes.
    """
    def named(x):
        return x["line"].rlike(FEATURE_NAME)

    def joined(cond):
        return F.array_join(F.transform(F.filter("lines", cond), lambda x: x["line"]), " ")

    def listed(section, cond):
        return F.transform(F.filter("lines", lambda x: (x["section"] == section) & cond(x)), lambda x: x["line"])

    bullet = lambda x: x["line"].startswith("-")
    return df.withColumns({
        "conclusion": joined(lambda x: x["section"] == "conclusion"),
        "additional_notes": joined(lambda x: (x["section"] == "additional_notes") | ((x["section"] == "key_features") & ~named(x))),
        "performance_metrics": listed("performance_metrics", bullet),
        "model_params": listed("model_params", bullet),
        "key_features": listed("key_features", named),
    }).drop("lines")


def feature_pairs(df: DataFrame, line: str) -> DataFrame:
    """One row per 'name' (0.123) pair in the text column."""
    pairs = F.arrays_zip(F.regexp_extract_all(line, F.lit(FEATURE_NAME), F.lit(1)).alias("name"),
                         F.regexp_extract_all(line, F.lit(FEATURE_VALUE), F.lit(1)).alias("value"))
    out = df.withColumn("_p", F.explode(pairs))
    value = F.trim("_p.value")
    return out.withColumns({"name": F.trim("_p.name"), "value": value,
                            "numeric_value": value.try_cast("double")}).drop("_p")


def bullets(df: DataFrame, items: str) -> DataFrame:
    """One row per bullet line "- **Name:** value - description" of an array column; a line
    without a colon is all description."""
    rows = df.withColumn("_line", F.explode(items))
    rows = rows.withColumn("_text", F.trim(F.replace(F.regexp_replace("_line", "^[- ]+", ""), F.lit("**"), F.lit(""))))
    # [before the first colon, after it], then [before the first dash, after it]
    rows = rows.withColumn("_c", F.split("_text", ":", 2))
    rows = rows.withColumn("_d", F.split(F.coalesce(F.get("_c", F.lit(1)), F.lit("")), "-", 2))
    named = F.size("_c") > 1
    tail = F.trim(F.coalesce(F.get("_d", F.lit(1)), F.lit("")))
    return rows.withColumns({
        "name": F.when(named, F.trim(F.get("_c", F.lit(0)))).otherwise(""), "value": F.trim(F.get("_d", F.lit(0))),
    }).withColumns({
        "numeric_value": F.regexp_extract("value", NUMBER, 0).try_cast("double"),
        "description": F.when(named, tail).otherwise(F.col("_text")),
    }).drop("_line", "_text", "_c", "_d", items)


def clean_responses(df: DataFrame, text: str = "text", out: str = "fields") -> DataFrame:
    """Model answers as maps: code fence off, parsed, empty values out, keys stripped to letters,
    digits and blanks.  NULL when an answer is no JSON object or nothing is left; the last of equal keys wins."""
    body = F.regexp_replace(F.trim(text), FENCE, "")
    parsed = F.map_filter(F.from_json(body, "map<string,string>"), lambda k, v: v.isNotNull())
    # columns of their own, so that the text is parsed once
    rows = df.withColumn("_pairs", F.transform(F.map_entries(parsed), lambda e: F.struct(
        F.regexp_replace(e["key"], KEY_JUNK, "").alias("key"), e["value"].alias("value"))))
    rows = rows.withColumn("_n", F.size("_pairs"))
    last = F.filter("_pairs", lambda e, i: ~F.exists(
        F.slice("_pairs", i + 2, F.col("_n")), lambda x: x["key"] == e["key"]))
    return rows.withColumn(out, F.when(F.col("_n") > 0, F.map_from_entries(last))).drop("_pairs", "_n")


def importance_rows(df: DataFrame, column: str = "feature_importance") -> DataFrame:
    """{"feature":{i:name},"importance":{i:value}} as one row per feature."""
    shape = "feature map<string,string>, importance map<string,double>"
    out = df.withColumn("_j", F.from_json(column, shape)).select(
        *[c for c in df.columns if c != column], F.explode("_j.feature").alias("_k", "feature"), "_j")
    return out.withColumns({"i": F.col("_k").cast("int"), "importance": F.coalesce(
        F.try_element_at("_j.importance", F.col("_k")), F.lit(0.0))}).filter("feature IS NOT NULL").drop("_k", "_j")


def importance_json(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The stored JSON again, from one row per feature."""
    pairs = F.sort_array(F.collect_list(F.struct("i", "feature", "importance")))

    def side(field):
        return F.map_from_entries(F.transform(F.col("_p"), lambda x: F.struct(x["i"].cast("string"), x[field])))
    return rows.groupBy(*keys).agg(pairs.alias("_p")).select(*keys, F.to_json(F.struct(
        side("feature").alias("feature"), side("importance").alias("importance"))).alias("feature_importance"))


def predictions_json(rows: DataFrame, keys: list[str], date: str, fields: list[str]) -> DataFrame:
    """{date: {field: value}} per model, dates in order; at most one entry per calendar day."""
    entry = F.struct(F.col(date).cast("string").alias("key"), F.struct(*fields).alias("value"))
    return rows.groupBy(*keys).agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(entry)))).alias("predictions_json"))


def model_category(explanation: Column) -> Column:
    low = F.lower(explanation)
    return F.when(low.contains("classification") | low.contains("classifier"), "classification").when(
        low.contains("regression") | low.contains("regressor"), "regression").otherwise("general")


def percent_text(x: Column) -> Column:
    return F.format_string("%.2f%%", x * 100)


def _section(heading: str, lines: list[Column]) -> Column:
    """A heading and its lines; nothing where every line is NULL."""
    body = F.concat_ws("\n", *lines)
    return F.when(body != "", F.concat(F.lit(f"**{heading}:**\n"), body))


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"- **{name}:** "), value)


def narrative(category: Column, fields: dict[str, Column]) -> Column:
    """A model's description from its numbers, by category: what it expects, how well it did, the details of the
    forecast, its strongest features, its confusion matrix and its parameters.  Parts without numbers are left out."""
    def get(name: str) -> Column:
        return fields.get(name, F.lit(None).cast("string"))
    to = F.concat(F.lit(" on "), get("prediction_date"))
    price = F.concat(F.lit("Expected price of "), get("symbol"), to, F.lit(": $"), get("amount"))
    direction = F.concat(F.lit("Expected direction of "), get("symbol"), to, F.lit(": *"), get("movement"), F.lit("*"))
    regression, classes = category == "regression", category == "classification"
    measures = [F.when(classes, _line(n, get(k))) for n, k in (("Accuracy", "accuracy"), ("Precision", "precision"), ("Recall", "recall"), ("F1 Score", "f1"), ("ROC AUC", "roc_auc"))]
    measures += [F.when(~classes, _line(n, get(k))) for n, k in (("RMSE", "rmse"), ("MAE", "mae"), ("MAPE", "mape"), ("Confidence Score", "confidence"))]
    details = [F.when(regression, _line("Predicted Amount", get("amount"))), F.when(classes, _line("Confidence Level", get("probability"))),
               _line("Last Known Price", get("last_known_price"))]
    cells = [F.when(classes, _line(n, get(k))) for n, k in (("True Positives", "tp"), ("True Negatives", "tn"), ("False Positives", "fp"), ("False Negatives", "fn"))]
    return F.concat_ws("\n\n", _section("Conclusion", [F.when(regression, price).otherwise(direction)]), _section("Performance Metrics", measures),
                       _section("Prediction Details", details), _section("Key Influencing Features", [F.concat(F.lit("- "), get("features"))]),
                       _section("Confusion Matrix", cells), _section("Model Parameters", [F.concat(F.lit("- "), get("parameters"))]))
