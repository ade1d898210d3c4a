"""Extraction responses that arrive as a table, and their fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folioscope.functions.text import strip
from folioscope.operators.extraction import CLAIM_MARK
from folioscope.schemas import RESPONSE

# Fixed values.
RESPONSE_METHOD, RESPONSE_CONFIDENCE = "llm", 0.85


def response_body(raw: Column) -> Column:
    """Response text without a surrounding code fence."""
    text = strip(raw)
    inner = F.regexp_replace(text, "^`+|`+$", "")
    inner = F.when(inner.startswith("json"), F.substring(inner, 5, 2147483647)).otherwise(inner)
    return F.when(text.startswith("```"), strip(inner)).otherwise(text)


def read_responses(responses: DataFrame) -> DataFrame:
    """Responses with their text replaced by ``r``, the parsed body, whose ``_bad`` is set
    where it is no JSON object and nothing else. ``parse_responses`` and ``parsed_papers``
    take either form; where both are asked for, this table is best written once.

    As the value of one of two keys made of its own digest, a body that closes
    early hides the second key, and one with more after it adds others."""
    if "response" not in responses.columns:
        return responses
    bodies = responses.withColumn("_body", response_body(F.col("response"))).withColumn("_digest", F.md5("_body"))
    body, digest = F.col("_body"), F.col("_digest")
    strict = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
    inside = F.concat(F.lit('{"'), digest, F.lit('":'), body, F.lit(',"end'), digest, F.lit('":1}'))
    keys = F.map_keys(F.from_json(inside, "map<string,string>", strict))
    alone = F.sort_array(keys) == F.sort_array(F.array(digest, F.concat(F.lit("end"), digest)))
    safe = F.when(body.startswith("{") & F.coalesce(alone, F.lit(False)), body).otherwise("{")
    parsed = F.from_json(safe, f"{RESPONSE}, _bad STRING", strict | {"columnNameOfCorruptRecord": "_bad"})
    return bodies.withColumn("r", parsed).drop("response", "_body", "_digest")


def parsed_papers(responses: DataFrame) -> DataFrame:
    """Papers whose response is a JSON object."""
    return read_responses(responses).where(F.col("r._bad").isNull()).select("paper_id").distinct()


def parse_responses(responses: DataFrame, strict: bool = False) -> DataFrame:
    """Responses (paper_id, title, paper_ord, response) to facts in the shape of
    the heuristic extraction. Items without a name (claims: description) are
    skipped; claims keep the number of their place in the list. A response that
    is no JSON object gives no rows, or with ``strict`` fails the job."""
    parsed = read_responses(responses).select("paper_id", "title", "paper_ord", "r")
    # a body that did not parse has no lists, so it explodes to nothing
    good = F.col("r._bad").isNull()
    if strict:
        good = F.when(good, True).otherwise(
            F.raise_error(F.lit("extraction response is not a JSON object")).cast("boolean")
        )
    empty = F.array().cast(
        "array<struct<entity_type:string,relationship_type:string,name:string,description:string,evidence:string>>"
    )

    def items(field: str, kind: str, edge: str) -> Column:
        text = lambda x: x["description"] if field == "methods" else F.lit(None).cast("string")
        return F.coalesce(
            F.transform(
                F.when(good, F.col(f"r.{field}")),
                lambda x: F.struct(
                    F.lit(kind).alias("entity_type"),
                    F.lit(edge).alias("relationship_type"),
                    x["name"].alias("name"),
                    text(x).alias("description"),
                    text(x).alias("evidence"),
                ),
            ),
            empty,
        )

    claims = F.coalesce(
        F.transform(
            F.when(good, F.col("r.claims")),
            lambda c, i: F.struct(
                F.lit("claim").alias("entity_type"),
                F.lit("mentions").alias("relationship_type"),
                F.when(
                    c["description"] != "",
                    F.concat(F.col("title"), F.lit(CLAIM_MARK), (i + 1).cast("string")),
                ).alias("name"),
                c["description"].alias("description"),
                F.coalesce(c["evidence"], c["description"]).alias("evidence"),
            ),
        ),
        empty,
    )
    facts = F.filter(
        F.concat(
            items("methods", "method", "proposes"),
            items("datasets", "dataset", "evaluated_on"),
            items("metrics", "metric", "mentions"),
            claims,
        ),
        lambda f: F.coalesce(f["name"], F.lit("")) != "",
    )
    return parsed.select("paper_id", "title", "paper_ord", F.posexplode(facts).alias("ord", "f")).select(
        "paper_id",
        "title",
        "paper_ord",
        "ord",
        "f.*",
        F.lit(RESPONSE_METHOD).alias("extraction_method"),
        F.lit(RESPONSE_CONFIDENCE).alias("confidence"),
    )


def coalesce_extractions(from_responses: DataFrame, heuristic: DataFrame, ok_papers: DataFrame) -> DataFrame:
    """Per paper the response rows where its response parsed, else the heuristic
    rows; never both."""
    return from_responses.unionByName(
        heuristic.join(ok_papers.select("paper_id"), "paper_id", "left_anti").select(
            *from_responses.columns
        )
    )
