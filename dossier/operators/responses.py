"""External responses in place of computed outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.functions.values import AGENTS
from dossier.sources.schemas import camel


def newest_valid(responses: DataFrame) -> DataFrame:
    """request_id, agent_id and content of the last valid response to each.

    responses: request_id, agent_id, content, and received_at if there is one; the greatest content of those received
    last. Any JSON is valid, without a check of its fields; missing, empty or unparseable content is not, however new.
    """
    given = responses if "received_at" in responses.columns else responses.withColumn("received_at", F.lit(None).cast("timestamp"))
    valid = given.filter((F.col("content") != "") & F.try_parse_json("content").isNotNull())
    return valid.groupBy("request_id", "agent_id").agg(F.max_by("content", F.struct("received_at", "content")).alias("content"))


def _whole(value: Column, kind: T.StructType) -> Column:
    """A struct with empty arrays in place of missing ones."""
    fields = [F.coalesce(value[f.name], F.array().cast(f.dataType)) if isinstance(f.dataType, T.ArrayType) else value[f.name] for f in kind.fields]
    return F.struct(*(x.alias(f.name) for x, f in zip(fields, kind.fields, strict=True)))


def parsed(content: Column, schema: str) -> Column:
    """Valid content as a struct of `schema`, whose fields JSON has in camel case: missing ones are null, arrays empty.

    Null for null content.
    """
    given = F.from_json(content, camel(schema)).cast(schema)
    return F.when(content.isNotNull(), _whole(given, T.DataType.fromDDL(schema)))


def with_responses(rows: DataFrame, responses: DataFrame) -> DataFrame:
    """rows (request_id, ...) with `responses`, a map of each analysis to the last valid response; six entries at most."""
    known = newest_valid(responses.filter(F.col("agent_id").isin(*AGENTS)))
    gathered = known.groupBy(F.col("request_id").alias("_request")).agg(F.map_from_entries(F.collect_list(F.struct("agent_id", "content"))).alias("responses"))
    return rows.join(gathered, F.col("request_id") == F.col("_request"), "left").drop("_request")


def merge_responses(computed: DataFrame, responses: DataFrame, schema: str) -> DataFrame:
    """computed (request_id, agent_id, output) with the last valid response's output where there is one, and `external`.

    responses: as newest_valid() takes them. `schema` is that of the content; fields that a response lacks are null,
    arrays empty.
    """
    joined = computed.join(newest_valid(responses), ["request_id", "agent_id"], "left")
    given = _whole(F.from_json("content", schema), computed.schema["output"].dataType)
    external = F.col("content").isNotNull()
    return joined.select("request_id", "agent_id", external.alias("external"), F.when(external, given).otherwise(F.col("output")).alias("output"))
