"""Inputs of the registered queries, as SQL that Spark and DuckDB both read.

The driver's texts hold no filing language, so each section gets one of a few fixed sentences by its doc_id; without
them, every dictionary would count zero on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from filingforge.session import spread, table

#: One of these is appended to each document, by doc_id modulo their number.
SEEDS = (
    "We may face litigation and regulatory inquiry from time to time. There can be no assurance that losses of $1,200.50 or 12.5% will not occur.",
    "Management identified a material weakness in our China segment. Liquidity could decline and covenants might restrict us; working capital deficit remains uncertain.",
    "No material weakness was found in 2023. Revenue grew 7% to $3,400 in North America and demand declined in two markets.",
    "Substantial doubt about our ability to continue as a going concern exists. The lender granted a waiver; default under our credit agreement is possible.",
    "A ransomware attack caused a data breach. Board oversight of our program continues. We believe margin pressure and cost inflation will persist.",
    "The company shall comply with mandatory obligations. We received a subpoena. A settlement of 45 claims was approved on March 3, 2022.",
    "We got a Wells notice from the Department of Justice. Material litigation is pending, and a cease-and-desist order was settled.",
    "A significant deficiency was found; disclosure controls and procedures were not effective. The 2021 report was restated on non-reliance, with a change in certifying accountant. We withdraw our guidance.",
    "Results were stable.",
)
SECTION_NAMES = ("item_1a_risk_factors", "item_7_mdna", "item_3_legal_proceedings", "item_9a_controls", "item_2_mdna", "item_1_05")


def case(expression: str, values: tuple[str, ...]) -> str:
    quoted = [v.replace("'", "''") for v in values]
    return f"CASE {expression} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(quoted)) + " END"


#: doc_id, section, text.
SECTIONS_SQL = f"SELECT doc_id, {case(f'doc_id % {len(SECTION_NAMES)}', SECTION_NAMES)} AS section, coalesce(text, '') || ' ' || {case(f'doc_id % {len(SEEDS)}', SEEDS)} AS text FROM documents"
#: Filings of six documents in a row: filing_id, section, section_ord, text.
FILINGS_SQL = f"SELECT doc_id, CAST(floor(doc_id / {len(SECTION_NAMES)}) AS BIGINT) AS filing_id, CAST(doc_id % {len(SECTION_NAMES)} AS INT) AS section_ord, section, text FROM ({SECTIONS_SQL}) AS s"
#: Turns of conversations and the turns before them, each with a seed: id, text, prior_text.
TURNS_SQL = f"""
SELECT c.conv_id * 1000 + c.turn AS id, c.text || '. ' || {case(f'(c.conv_id + c.turn) % {len(SEEDS)}', SEEDS)} AS text,
       p.text || '. ' || {case(f'(p.conv_id + p.turn * 3) % {len(SEEDS)}', SEEDS)} AS prior_text
FROM conversations c LEFT JOIN conversations p ON c.conv_id = p.conv_id AND c.turn = p.turn + 1
WHERE c.text IS NOT NULL
"""


def frame(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    """The SQL over the driver's tables, which are passed by name and not registered anywhere."""
    return spark.sql(" ".join(sql.split("\n")).replace("{", "{{").replace("}", "}}") if not names else _bind(sql, names), **{n: spread(table(spark, sf_dir, n)) for n in names})


def _bind(sql: str, names: tuple[str, ...]) -> str:
    import re

    sql = sql.replace("{", "{{").replace("}", "}}")
    for name in names:
        sql = re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {{{name}}}", sql)
    return sql
