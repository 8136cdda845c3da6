"""Field candidates from text blocks.

One projection reads every pattern off a block; blocks without any finding stop
there.  The rest is shuffled once, by document: windows in reading order carry the open
section forward and the next tax base backward.  Aggregates keep the first finding of
each field.
"""

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import MONEY, matched_amount, strip
from ..functions.text import contains_any
from ..functions.tax_rates import RATE, pointed_rate

DOCUMENT = ("doc_id",)
READING_ORDER = ("page", "y0", "block_seq")
_FIRST_FIELDS = ("number", "issue_date", "supplier_tax_id", "customer_tax_id", "net", "tax", "gross")
# Inside one block a tax pair stands before the base, so it may take a base of its own block.
_FACT_PAIR, _FACT_BASE = 100, 1_000_000


def _amounts(text: Column, pattern: str, group: int) -> Column:
    """Raw amounts of all matches."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _first_amount(raw_amounts: Column) -> Column:
    """First one that reads as an amount; mostly that is the first at all."""
    return F.coalesce(
        matched_amount(F.get(raw_amounts, F.lit(0))),
        F.get(F.array_compact(F.transform(raw_amounts, matched_amount)), F.lit(0)),
    )


def _tax_pairs(text: Column) -> Column:
    return F.arrays_zip(
        _amounts(text, fv.TAX_RATE_AND_AMOUNT, 1).alias("rate"),
        _amounts(text, fv.TAX_RATE_AND_AMOUNT, 2).alias("amount"),
    )


def _fact(fact, place: int, value: Column, confidence, rate: Column | None = None) -> Column:
    return F.struct(
        F.lit(fact).alias("fact"),
        (place if isinstance(place, Column) else F.lit(place)).cast("int").alias("fact_seq"),
        value.cast("string").alias("value"),
        F.lit(confidence).cast("double").alias("confidence"),
        (F.lit(None) if rate is None else rate).cast(RATE).alias("rate"),
    )


def text_after(text: Column, pattern: str) -> Column:
    """What follows the first character of the first match, cut by pattern: offsets count
    differently for characters that need two units."""
    groups = len(re.findall(r"(?<!\\)\((?!\?)", pattern))
    return F.regexp_extract(text, f"(?s)(?=(?:{pattern})).(.*)", groups + 1)


# A piece of every text that a pattern can match, in lower case. Pieces have no i, s or k: these fold with further
# Unicode letters (dotless i, long s, Kelvin sign), all other ASCII letters only with themselves.
_SELLER_PARTS = ("em", "prove", "vend", "parte", "from", "uppl", "eller")
_BUYER_PARTS = ("dom", "cl", "compr", "buyer", "tomer", "purcha", "to")
_BASE_PARTS = ("ba", "mpon")
_TAX_PARTS = ("va", "v.a", "mpue", "tax")
_DATE_PARTS = ("fecha", "em", "date")
_COMPANY_PARTS = tuple(s + p for s in "s\u017f" for p in ("l", ".l", "a", ".a")) + ("tada", "ma", "断续")
_TOTAL_PARTS = ("total", "amount")
_NUMBER_PARTS = ("/", "-", "f")


def block_facts(blocks: DataFrame) -> DataFrame:
    """Everything a block tells by itself, one row per fact.

    Words are looked for first, by plain pieces of them and then by pattern; values are read only where their words stand.  A
    block that tells nothing yields no row, so it is never shuffled.  Facts are made
    in projections and unfolded after them: a generator would make them one by one, interpreted.
    """
    text = F.col("text")
    low = F.col("low")
    words = blocks.withColumn("low", F.lower("text")).select(
        "doc_id",
        "page",
        F.col("bbox.y0").alias("y0"),
        "block_seq",
        "bbox",
        "source",
        "text",
        "low",
        strip(text).alias("line"),
        (contains_any(low, _SELLER_PARTS) & text.rlike(fv.SELLER_WORDS)).alias("seller"),
        (contains_any(low, _BUYER_PARTS) & text.rlike(fv.BUYER_WORDS)).alias("buyer"),
        (contains_any(low, _BASE_PARTS) & text.rlike(fv.BASE_WORDS)).alias("is_base"),
        (contains_any(low, _TAX_PARTS) & text.rlike(fv.TAX_WORDS)).alias("is_tax"),
        (contains_any(low, _DATE_PARTS) & text.rlike(fv.DATE_WORDS)).alias("is_date"),
    )
    seller, buyer = F.col("seller"), F.col("buyer")
    after_buyer = text_after(text, fv.BUYER_WORDS)

    def date_part(pattern: str) -> Column:
        return F.when(F.col("is_date"), F.regexp_extract(text, pattern, 0))

    def pointed(col: Column) -> Column:
        return F.replace(col, F.lit(","), F.lit("."))

    line = F.col("line")
    fits = ~seller & ~buyer & F.length(line).between(fv.NAME_MIN_LENGTH, fv.NAME_MAX_LENGTH)
    company = contains_any(low, _COMPANY_PARTS) & text.rlike(fv.COMPANY_FORM)
    plain = line.rlike(fv.NAME_START) & ~line.rlike(fv.NOT_A_NAME)
    raw = words.select(
        "doc_id",
        *READING_ORDER,
        "bbox",
        "source",
        F.when(seller, "supplier").when(buyer, "customer").alias("opens"),
        "line",
        F.when(
            fits, F.when(company, fv.CONF_NAME_COMPANY).when(plain, fv.CONF_NAME_PLAIN)
        ).alias("name_confidence"),
        F.when(contains_any(low, _NUMBER_PARTS), strip(F.regexp_extract(text, fv.INVOICE_NUMBER, 0))).alias("number"),
        date_part(fv.DATE_DAY_FIRST).alias("day_first"),
        date_part(fv.DATE_YEAR_FIRST).alias("year_first"),
        F.when(seller, F.regexp_extract(text, fv.TAX_ID_IN_TEXT, 0)).alias("seller_id"),
        F.when(seller, F.regexp_extract(text, fv.DASHED_NIF_IN_TEXT, 0)).alias("seller_dashed"),
        F.when(buyer, F.regexp_extract(after_buyer, fv.TAX_ID_IN_TEXT, 0)).alias("buyer_id"),
        F.when(buyer, F.regexp_extract(after_buyer, fv.DASHED_NIF_IN_TEXT, 0)).alias("buyer_dashed"),
        F.when(F.col("is_base"), _amounts(text, fv.BASE_AMOUNT, 2)).alias("base_amounts"),
        F.when(F.col("is_tax") & ~F.col("is_base"), _amounts(text, fv.EURO_AMOUNT, 1)).alias(
            "tax_amounts"
        ),
        F.when(contains_any(low, _TOTAL_PARTS) & text.rlike(fv.TOTAL_WORDS), _amounts(text, fv.TOTAL_AMOUNT, 2)).alias("gross_amounts"),
        F.when(
            F.col("is_tax"),
            F.transform(
                _tax_pairs(text),
                lambda p: F.struct(
                    pointed(p["rate"]).try_cast(RATE).alias("rate"),
                    pointed(p["amount"]).try_cast(MONEY).alias("amount"),
                ),
            ),
        ).alias("pairs"),
    )

    values = raw.select(
        "*",
        _first_amount(F.col("base_amounts")).alias("base"),
        _first_amount(F.col("tax_amounts")).alias("tax"),
        _first_amount(F.col("gross_amounts")).alias("gross"),
    )

    def told(fact: str, place: int, confidence) -> Column:
        return F.when(F.col(fact).isNotNull(), _fact(fact, place, F.col(fact), confidence))

    def tax_id(fact: str, place: int, plain_id: str, dashed: str) -> Column:
        return F.when(
            F.col(plain_id) != "", _fact(fact, place, F.col(plain_id), fv.CONF_TAX_ID)
        ).when(
            F.col(dashed) != "",
            _fact(
                fact, place, F.replace(F.col(dashed), F.lit("-"), F.lit("")), fv.CONF_TAX_ID_DASHED
            ),
        )

    def date(column: str) -> Column:
        return _fact("issue_date", 3, F.translate(F.col(column), "/.", "--"), fv.CONF_DATE)

    single = F.array(
        told("opens", 0, None),
        F.when(
            F.col("name_confidence").isNotNull(), _fact("name", 1, line, F.col("name_confidence"))
        ),
        F.when(F.col("number") != "", _fact("number", 2, F.col("number"), fv.CONF_NUMBER)),
        F.when(F.col("day_first") != "", date("day_first")).when(
            F.col("year_first") != "", date("year_first")
        ),
        tax_id("supplier_tax_id", 4, "seller_id", "seller_dashed"),
        tax_id("customer_tax_id", 5, "buyer_id", "buyer_dashed"),
        told("tax", 6, fv.CONF_TAX),
        told("gross", 7, fv.CONF_GROSS),
        F.when(F.col("base").isNotNull(), _fact("net", _FACT_BASE, F.col("base"), fv.CONF_NET)),
    )
    in_range = F.filter(
        "pairs",
        lambda p: p["rate"].between(fv.TEXT_RATE_MIN, fv.TEXT_RATE_MAX) & p["amount"].isNotNull(),
    )
    pairs = F.transform(
        in_range,
        lambda p, i: _fact("pair", i + _FACT_PAIR, p["amount"], fv.CONF_TAX_LINE, p["rate"]),
    )
    here = ("doc_id", *READING_ORDER, "bbox", "source")
    made = values.select(*here, single.alias("single"), F.coalesce(pairs, F.array()).alias("several"))
    return made.select(*here, F.inline(F.concat("single", "several"))).filter(F.col("value").isNotNull())


_FACT_ORDER = (*READING_ORDER, "fact_seq")
_SECTIONS = ("supplier", "customer")


def _value_of(fact: str) -> Column:
    return F.when(F.col("fact") == fact, F.col("value"))


def _in_reading_order(facts: DataFrame, keys: tuple = DOCUMENT) -> DataFrame:
    """Section, next base and rank of names.

    Facts move once, by document, and windows in reading order carry sections and bases
    across its pages; they sort and spill, so a document of any length needs no more memory.
    """
    w = Window.partitionBy(*keys).orderBy(*_FACT_ORDER)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = facts.withColumns(
        {
            "section": F.last(_value_of("opens"), ignorenulls=True).over(so_far),
            "next_base": F.expr(
                "lead(case when fact = 'net' then value end) ignore nulls over "
                f"(partition by {', '.join(keys)} order by {', '.join(_FACT_ORDER)})"
            ),
        }
    )
    is_name = F.col("fact") == "name"
    here = {x: F.col("section") == x for x in _SECTIONS}
    rank = F.coalesce(*[F.when(where, F.count(F.when(is_name & where, 1)).over(so_far)) for where in here.values()])
    return placed.withColumn("name_rank", F.when(is_name, rank))


def _first_findings(ordered: DataFrame, names_per_section: int, keys: tuple = DOCUMENT) -> DataFrame:
    """One row per document (or other ``keys``) with the first finding of each field.

    Grouping goes by (document, rate) and then by document; a document has at
    most as many groups as there are rates with two decimals between 1 and 27.
    """
    hit = F.struct(*READING_ORDER, "value", "confidence", "bbox", "source")
    is_name = F.col("fact") == "name"
    fields = {f: F.min(F.when(F.col("fact") == f, hit)) for f in _FIRST_FIELDS}
    for section in _SECTIONS:
        for rank in range(1, names_per_section + 1):
            mine = is_name & (F.col("section") == section) & (F.col("name_rank") == rank)
            fields[f"{section}_name_{rank}"] = F.min(F.when(mine, hit))
    tax_line = F.min(
        F.when(
            F.col("rate").isNotNull(),
            F.struct(
                *_FACT_ORDER,
                F.col("value").alias("amount"),
                "bbox",
                "source",
                F.col("next_base").alias("base"),
                "rate",
            ),
        )
    )
    by_rate = ordered.groupBy(*keys, "rate").agg(
        *[expr.alias(name) for name, expr in fields.items()], tax_line.alias("tax_line")
    )
    return by_rate.groupBy(*keys).agg(
        *[F.min(name).alias(name) for name in fields],
        F.array_sort(F.collect_list("tax_line")).alias("rates"),
    )


def findings_in_order(blocks: DataFrame) -> DataFrame:
    """Facts of all blocks with the section they stand in, the next base and the rank of names."""
    return _in_reading_order(block_facts(blocks))


def document_findings(
    blocks: DataFrame, names_per_section: int = fv.NAMES_KEPT_PER_SECTION
) -> DataFrame:
    """First findings of every document that has any, whatever its length.

    ``names_per_section`` company names are weighed in each section, the first ones in
    reading order; later names of a section don't count, even if they look better.
    """
    return _settle(_first_findings(findings_in_order(blocks), names_per_section), names_per_section)


def findings_by_source(
    blocks: DataFrame, names_per_section: int = fv.NAMES_KEPT_PER_SECTION
) -> DataFrame:
    """First findings of every document in the blocks of each source, so that sources can compete."""
    keys = (*DOCUMENT, "source")
    ordered = _in_reading_order(block_facts(blocks), keys)
    return _settle(_first_findings(ordered, names_per_section, keys), names_per_section).drop("source")


def _settle(first: DataFrame, names_per_section: int) -> DataFrame:
    """Totals found after the gross block do not count; the better of two names wins."""

    def block_of(total: str) -> Column:
        return F.struct(*[F.col(f"{total}.{c}") for c in READING_ORDER])

    def until_gross(total: str) -> Column:
        return F.when(
            F.col("gross").isNull() | (block_of(total) <= block_of("gross")), F.col(total)
        )

    def better(section: str) -> Column:
        best = F.col(f"{section}_name_1")
        for rank in range(2, names_per_section + 1):
            name = F.col(f"{section}_name_{rank}")
            best = F.when(name["confidence"] > best["confidence"], name).otherwise(best)
        return best

    return first.withColumns(
        {
            "net": until_gross("net"),
            "tax": until_gross("tax"),
            "supplier_name": better("supplier"),
            "customer_name": better("customer"),
        }
    )


# Columns of the findings row behind each resolved field.
FIELD_COLUMNS = {
    "invoice_data.number": "number",
    "invoice_data.issue_date": "issue_date",
    "supplier.tax_id": "supplier_tax_id",
    "supplier.legal_name": "supplier_name",
    "customer.tax_id": "customer_tax_id",
    "customer.legal_name": "customer_name",
    "totals.net_amount": "net",
    "totals.tax_amount": "tax",
    "totals.gross_amount": "gross",
}


def _candidate(field: str, hit: Column, seq: int, normalized: bool = False) -> Column:
    return F.when(
        hit.isNotNull(),
        F.struct(
            F.lit(field).alias("field_name"),
            hit["value"].alias("value"),
            (hit["value"] if normalized else F.lit(None).cast("string")).alias("normalized_value"),
            hit["confidence"].alias("confidence"),
            hit["page"].alias("page"),
            hit["bbox"].alias("bbox"),
            hit["source"].alias("source"),
            F.lit(seq).alias("cand_seq"),
        ),
    )


def tax_line_parts(line: Column, index: Column) -> Column:
    """Rate, base and amount of one tax line as candidate rows; no base, no base row."""
    key = pointed_rate(line["rate"])

    def part(name: str, value: Column, page: Column, bbox: Column, place: int) -> Column:
        return F.struct(
            F.concat(F.lit("tax_lines["), key, F.lit("]."), F.lit(name)).alias("field_name"),
            value.alias("value"),
            F.lit(None).cast("string").alias("normalized_value"),
            F.lit(fv.CONF_TAX_LINE).alias("confidence"),
            page.alias("page"),
            bbox.alias("bbox"),
            line["source"].alias("source"),
            (100 + index * 3 + place).cast("int").alias("cand_seq"),
        )

    return F.array_compact(
        F.array(
            part("tax_rate", key, line["page"], line["bbox"], 0),
            F.when(
                line["base"].isNotNull(),
                part("tax_base", line["base"], line["page"], line["bbox"], 1),
            ),
            part("tax_amount", line["amount"], line["page"], line["bbox"], 2),
        )
    )


def candidates(findings: DataFrame) -> DataFrame:
    """Long table of candidates, in the order they are added to a document."""
    head = [
        _candidate("invoice_data.number", F.col("number"), 0),
        _candidate("invoice_data.issue_date", F.col("issue_date"), 1),
        _candidate("supplier.tax_id", F.col("supplier_tax_id"), 2, normalized=True),
        _candidate("customer.tax_id", F.col("customer_tax_id"), 3, normalized=True),
    ]
    kept = sum(c.startswith("supplier_name_") for c in findings.columns)
    for i, section in enumerate(_SECTIONS):
        for rank in range(1, kept + 1):
            hit = F.col(f"{section}_name_{rank}")
            head.append(_candidate(f"{section}.legal_name", hit, 10 + 10 * i + rank))
    tail = [
        _candidate("totals.net_amount", F.col("net"), 100_000),
        _candidate("totals.tax_amount", F.col("tax"), 100_001),
        _candidate("totals.gross_amount", F.col("gross"), 100_002),
    ]
    lines = F.flatten(F.transform("rates", tax_line_parts))
    # Made in a projection and unfolded after it: a generator with a filter inside would make them interpreted.
    made = findings.select("doc_id", F.array(*head).alias("head"), lines.alias("lines"), F.array(*tail).alias("tail"))
    every = F.concat("head", "lines", "tail")
    return made.select("doc_id", F.inline(every)).filter(F.col("cand_seq").isNotNull())


def candidate_count(findings: DataFrame) -> Column:
    """How many candidates a row of findings gives, without unfolding them."""
    names = [f"{x}_name_{i}" for x in _SECTIONS for i in range(1, sum(c.startswith("supplier_name_") for c in findings.columns) + 1)]
    single = [F.col(c).isNotNull().cast("int") for c in (*_FIRST_FIELDS, *names)]
    lines = F.aggregate("rates", F.lit(0), lambda n, x: n + F.when(x["base"].isNull(), 2).otherwise(3))
    return sum(single[1:], single[0]) + F.coalesce(lines, F.lit(0))


def best_candidates(rows: DataFrame) -> DataFrame:
    """Best candidate per document and field: highest confidence, then first added."""
    best = F.min(
        F.struct(
            (-F.col("confidence")).alias("worst"),
            "cand_seq",
            "value",
            "normalized_value",
            "confidence",
            "page",
            "bbox",
            "source",
        )
    )
    return (
        rows.groupBy("doc_id", "field_name")
        .agg(best.alias("best"))
        .select(
            "doc_id",
            "field_name",
            *[
                F.col(f"best.{c}").alias(c)
                for c in (
                    "value", "normalized_value", "confidence", "page", "bbox", "source", "cand_seq"
                )
            ],
        )
    )
