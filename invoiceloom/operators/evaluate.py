"""Scoring predicted records against expected ones.

Each invoice becomes one row per evaluated field in one projection; all roll-ups
come from one aggregate with grouping sets.
"""

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed_values as fv
from .. import schemas
from ..functions import normalize_legal_name, plain_rate
from ..sources.landed import file_key

DECIMAL = "decimal(28,6)"


@F.pandas_udf(T.DoubleType())
def gestalt_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Similarity of two texts; pairs with a NULL are passed over."""
    seen: dict = {}

    def ratio(a, b):
        if a is None or b is None:
            return None
        if (a, b) not in seen:
            seen[a, b] = SequenceMatcher(None, a, b).ratio()
        return seen[a, b]

    return pd.Series([ratio(a, b) for a, b in zip(left, right)], dtype="float64")


def _blank(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def verdict(match: Column, score: Column, detail: Column | None = None) -> Column:
    """What an evaluator says: match, score, and why a value does not match."""
    match = F.coalesce(match, F.lit(False))
    told = F.lit("") if detail is None else F.when(match, F.lit("")).otherwise(F.coalesce(detail, F.lit("")))
    return F.struct(
        match.alias("match"),
        F.coalesce(score, F.lit(0.0)).cast("double").alias("score"),
        told.alias("detail"),
    )


def _quoted(text: Column) -> Column:
    return F.concat(F.lit("'"), text, F.lit("'"))


def _expected_got(expected: Column, predicted: Column) -> Column:
    return F.concat(F.lit("expected "), expected, F.lit(", got "), predicted)


def _percent(share: Column) -> Column:
    return F.format_string("%.2f%%", share * 100)


def exact_match(expected: Column, predicted: Column) -> Column:
    same = _blank(expected) == _blank(predicted)
    detail = _expected_got(_quoted(_blank(expected)), _quoted(_blank(predicted)))
    return verdict(same, same.cast("double"), detail)


def _places(text: Column) -> Column:
    """Decimal places a number is written with, six at most."""
    return F.least(F.length(F.regexp_extract(text, r"\.([0-9]+)\s*$", 1)), F.lit(6))


def _with_places(number: Column, places: Column) -> Column:
    """A number of six places cut to fewer."""
    text = number.cast("string")
    return F.left(text, F.length(text) - F.when(places > 0, 6 - places).otherwise(7))


def amount_match(expected: Column, predicted: Column, tolerance=fv.MONEY_TOLERANCE) -> Column:
    """Within the tolerance: 1; else what is left after the relative difference."""
    e, p = expected.try_cast(DECIMAL), predicted.try_cast(DECIMAL)
    diff = F.abs(e - p).cast(DECIMAL)
    near = diff <= F.lit(str(tolerance)).cast("decimal(9,4)")
    relative = F.when(e == 0, F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), 1 - diff.cast("double") / F.abs(e).cast("double"))
    )
    shown = [x.cast("string") for x in (expected, predicted)]
    places = F.greatest(_places(shown[0]), _places(shown[1]))
    detail = F.when(diff.isNull(), F.lit("decimal parse error")).otherwise(
        F.concat(_expected_got(*shown), F.lit(", diff "), _with_places(diff, places))
    )
    return verdict(near, F.when(near, F.lit(1.0)).otherwise(relative), detail)


def name_match(expected: Column, predicted: Column, ratio: Column) -> Column:
    """Equal after normalising, or similar enough; ``ratio`` is asked for unequal names only."""
    same = normalize_legal_name(_blank(expected)) == normalize_legal_name(_blank(predicted))
    score = F.when(same, F.lit(1.0)).otherwise(ratio)
    return verdict(score >= fv.NAME_RATIO_MIN, score, F.concat(F.lit("similarity "), _percent(score)))


def name_ratio(expected: Column, predicted: Column) -> Column:
    left, right = normalize_legal_name(_blank(expected)), normalize_legal_name(_blank(predicted))
    return gestalt_ratio(F.when(left != right, left), F.when(left != right, right))


def tax_lines_match(expected: Column, predicted: Column, tolerance=fv.MONEY_TOLERANCE) -> Column:
    """Same count and line by line the same rate, base and amount; score is the mean."""
    none = F.array().cast("array<struct<tax_rate:string,tax_base:string,tax_amount:string>>")
    e, p = F.coalesce(expected, none), F.coalesce(predicted, none)
    limit = F.lit(str(tolerance)).cast("decimal(9,4)")

    def close(a: Column, b: Column, name: str) -> Column:
        zero = F.lit("0")
        return (
            F.abs(
                F.coalesce(a[name], zero).try_cast(DECIMAL) - F.coalesce(b[name], zero).try_cast(DECIMAL)
            )
            <= limit
        )

    def same_rate(a: Column, b: Column) -> Column:
        left, right = _blank(a["tax_rate"]), _blank(b["tax_rate"])
        return (left == right) | F.coalesce(
            left.try_cast(DECIMAL) == right.try_cast(DECIMAL), F.lit(False)
        )

    hits = F.zip_with(
        e,
        p,
        lambda a, b: F.when(
            same_rate(a, b) & close(a, b, "tax_base") & close(a, b, "tax_amount"), 1.0
        ).otherwise(0.0),
    )
    total = F.aggregate(hits, F.lit(0.0), lambda acc, x: acc + x)
    score = (
        F.when(F.size(e) != F.size(p), F.lit(0.0))
        .when(F.size(e) == 0, F.lit(1.0))
        .otherwise(total / F.size(e))
    )
    counts = _expected_got(F.size(e).cast("string"), F.size(p).cast("string"))
    detail = F.when(F.size(e) != F.size(p), F.concat(F.lit("line count mismatch: "), counts)).otherwise(
        F.concat(F.lit("avg_score="), _percent(score))
    )
    return verdict(score == 1.0, score, detail)


def totals_match(expected: Column, predicted: Column) -> Column:
    """Mean of the three amounts; a missing totals part or amount counts as 0."""
    parts = [
        amount_match(
            F.coalesce(expected[t], F.lit("0")), F.coalesce(predicted[t], F.lit("0"))
        )["score"]
        for t in ("net_amount", "tax_amount", "gross_amount")
    ]
    every = (parts[0] == 1.0) & (parts[1] == 1.0) & (parts[2] == 1.0)
    return verdict(every, (parts[0] + parts[1] + parts[2]) / 3)


def as_variant(df: DataFrame, record: str) -> Column:
    """A record of any shape: a struct, a VARIANT, or JSON text (NULL where it isn't JSON)."""
    kind = df.schema[record].dataType
    if isinstance(kind, T.VariantType):
        return F.col(record)
    return F.try_parse_json(F.col(record) if isinstance(kind, T.StringType) else F.to_json(record))


def _json_path(path: str) -> str:
    return "$" + "".join(f"['{step}']" for step in path.split("."))


def nested(df: DataFrame, record: str, path: str) -> Column:
    """Value at a dotted path of a record; NULL when any step is missing, also from the schema.

    Records that are no structs give text.
    """
    kind = df.schema[record].dataType
    if not isinstance(kind, T.StructType):
        return F.try_variant_get(as_variant(df, record), _json_path(path), "string")
    value = F.col(record)
    for step in path.split("."):
        if not isinstance(kind, T.StructType) or step not in kind.names:
            return F.lit(None).cast("string")
        kind, value = kind[step].dataType, value[step]
    return value


# What a value's type is called in details, by the start of its VARIANT type.
_TYPE_NAMES = {
    "VOID": "NoneType", "STRING": "str", "BIGINT": "int", "DOUBLE": "float", "FLOAT": "float", "DECIMAL": "float",
    "BOOLEAN": "bool", "ARRAY": "list", "OBJECT": "dict",
}


def value_facts(value: Column) -> Column:
    """What comparing a VARIANT by its type takes: kind, text, json; a missing value is a NoneType."""
    names = F.create_map(*[F.lit(x) for pair in _TYPE_NAMES.items() for x in pair])
    kind = F.try_element_at(names, F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0))
    return F.struct(
        F.coalesce(kind, F.lit("NoneType")).alias("kind"),
        F.try_variant_get(value, "$", "string").alias("text"),
        F.to_json(value).alias("json"),
    )


def fallback_match(expected: Column, predicted: Column) -> Column:
    """For fields without an evaluator, by the types of two values (``value_facts``); adds the ``metric`` used.

    Both missing match; two texts are compared as they are; where one is a number both count
    as amounts; everything else matches if it is the same JSON.
    """
    kinds = expected["kind"], predicted["kind"]
    numbers = ("int", "float", "bool")
    same = expected["json"].eqNullSafe(predicted["json"]) & (kinds[0] == kinds[1])
    mismatch = F.concat(F.lit("mismatch: <class '"), kinds[0], F.lit("'> vs <class '"), kinds[1], F.lit("'>"))

    def told(metric: str, found: Column) -> Column:
        return F.struct(found.alias("found"), F.lit(metric).alias("metric"))

    def both(name: str) -> Column:
        return (kinds[0] == name) & (kinds[1] == name)

    none = F.struct(F.lit(True).alias("match"), F.lit(1.0).alias("score"), F.lit("both null").alias("detail"))
    texts = expected["text"], predicted["text"]
    return (
        F.when(both("NoneType"), told("exact", none))
        .when(both("str"), told("exact", exact_match(*texts)))
        .when(kinds[0].isin(*numbers) | kinds[1].isin(*numbers), told("tolerance", amount_match(*texts)))
        .otherwise(told("structural", verdict(same, same.cast("double"), mismatch)))
    )


EVALUATORS = {
    "invoice_data.number": exact_match,
    "invoice_data.issue_date": exact_match,
    "supplier.legal_name": name_match,
    "supplier.tax_id": exact_match,
    "customer.legal_name": name_match,
    "customer.tax_id": exact_match,
    "tax_lines": tax_lines_match,
    "totals": totals_match,
}


def register_evaluator(path: str, evaluator) -> None:
    """Put another (expected, predicted) -> verdict function behind a field path."""
    EVALUATORS[path] = evaluator


def pair_records(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """Expected records with their prediction; no prediction is an empty record.

    Predictions are keyed by ``invoice_file``, or as read from files by ``invoice_key``, the
    name of the invoice without its suffix.
    """
    if "invoice_file" in predicted.columns:
        return expected.join(predicted, "invoice_file", "left")
    keyed = expected.withColumn("invoice_key", file_key(F.col("invoice_file")))
    return keyed.join(predicted, "invoice_key", "left")


_PARTS_OF = {
    "tax_lines": "array<struct<tax_rate:string,tax_base:string,tax_amount:string>>",
    "totals": "struct<net_amount:string,tax_amount:string,gross_amount:string>",
}


def evaluate_fields(pairs: DataFrame, paths=fv.EVALUATED_FIELDS) -> DataFrame:
    """One row per invoice and field: expected, predicted, match, score, metric, detail.

    Records may be structs, VARIANT or JSON text; a path that one lacks is a missing value.
    ``metric`` is the path where an evaluator is registered for it, else how the types of
    the two values were compared; ``detail`` says why a field does not match.
    The ratio of names runs in Python, in batches, and only unequal names reach it.
    """
    records = ("expected", "predicted")
    ratios = {
        p: f"ratio_{i}" for i, p in enumerate(paths) if EVALUATORS.get(p) is name_match
    }
    typed = {r: isinstance(pairs.schema[r].dataType, T.StructType) for r in records}

    def value(record: str, path: str) -> Column:
        found = nested(pairs, record, path)
        return found if typed[record] or path not in _PARTS_OF else F.from_json(found, _PARTS_OF[path])

    ready = pairs.withColumns({c: name_ratio(*[value(r, p) for r in records]) for p, c in ratios.items()}) if ratios else pairs
    loose = [p for p in paths if p not in EVALUATORS]
    if loose:
        ready = ready.withColumns({f"variant_{r}": as_variant(pairs, r) for r in records})
        at = lambda r, p: F.try_variant_get(F.col(f"variant_{r}"), _json_path(p), "variant")
        ready = ready.withColumns({f"facts_{r}_{i}": value_facts(at(r, p)) for i, p in enumerate(loose) for r in records})
        ready = ready.withColumns({f"compared_{i}": fallback_match(*[F.col(f"facts_{r}_{i}") for r in records]) for i in range(len(loose))})

    def shown(record: str, path: str) -> Column:
        found = nested(pairs, record, path)
        kind = pairs.select(found.alias("x")).schema["x"].dataType
        return F.to_json(found) if isinstance(kind, (T.StructType, T.ArrayType)) else found.cast("string")

    def row(path: str) -> Column:
        if path not in EVALUATORS:
            compared = F.col(f"compared_{loose.index(path)}")
            found, metric = compared["found"], compared["metric"]
        else:
            e, p = [value(r, path) for r in records]
            found = name_match(e, p, F.col(ratios[path])) if path in ratios else EVALUATORS[path](e, p)
            metric = F.lit(path)
        return F.struct(
            F.lit(path).alias("field_path"),
            shown("expected", path).alias("expected_value"),
            shown("predicted", path).alias("predicted_value"),
            found["match"].alias("match"),
            found["score"].alias("score"),
            metric.alias("metric"),
            found["detail"].alias("detail"),
        )

    return ready.select("invoice_file", "invoice_type", F.inline(F.array(*[row(p) for p in paths])))


def roll_ups(results: DataFrame) -> DataFrame:
    """Scores per invoice, errors per type, accuracy per field and the grand mean at once."""
    totals = results.groupingSets(
        [["invoice_file"], ["invoice_type"], ["field_path"], []],
        "invoice_file",
        "invoice_type",
        "field_path",
    ).agg(
        F.grouping_id().alias("gid"),
        F.count(F.lit(1)).alias("fields"),
        F.count(F.when(~F.col("match"), 1)).alias("errors"),
        F.avg("score").alias("score"),
        F.avg(F.col("match").cast("int")).alias("accuracy"),
    )
    level = (
        F.when(F.col("gid") == 3, "invoice")
        .when(F.col("gid") == 5, "type")
        .when(F.col("gid") == 6, "field")
        .otherwise("all")
    )
    return totals.select(
        level.alias("level"),
        F.coalesce("invoice_file", "invoice_type", "field_path").alias("key"),
        "fields",
        "errors",
        "score",
        "accuracy",
    )


def error_listing(results: DataFrame) -> DataFrame:
    """Wrong fields with their ``rank`` in the invoice, worst first; sorting is left to the sink."""
    worst = Window.partitionBy("invoice_file").orderBy("score", "field_path")
    return results.filter(~F.col("match")).withColumn("rank", F.row_number().over(worst))


def passes(results: DataFrame) -> DataFrame:
    """One row: whether every field matched."""
    return results.agg(
        (F.count(F.when(~F.col("match"), 1)) == 0).alias("passed"),
        F.count(F.when(~F.col("match"), 1)).alias("errors"),
        F.coalesce(F.avg("score"), F.lit(0.0)).alias("global_accuracy"),
    )


def response_as_text(responses: DataFrame) -> DataFrame:
    """Finished responses in the form records are scored in."""
    invoice = F.col("invoice")
    record = F.struct(
        invoice["invoice_data"].alias("invoice_data"),
        invoice["supplier"].alias("supplier"),
        invoice["customer"].alias("customer"),
        F.transform(
            invoice["tax_lines"], lambda x: x.withField("tax_rate", plain_rate(x["tax_rate"]))
        ).alias("tax_lines"),
        invoice["totals"].alias("totals"),
    )
    return responses.select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("invoice_file"),
        F.when(invoice.isNotNull(), record.cast(schemas.RECORD_TEXT)).alias("predicted"),
    )
