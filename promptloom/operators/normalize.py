"""Turn dynamic batch elements into prompt items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Failure texts that end up in the item table.
MALFORMED = "validation: malformed item (missing/invalid prompt)"
PREFIX = "validation: "
SEPARATOR = "; "


def row_label(row_number: Column) -> Column:
    """Id given to an element that brings none."""
    return F.concat(F.lit("row-"), row_number.cast("string"))


def normalise_elements(elements: DataFrame) -> DataFrame:
    """Add ``kind, external_id, prompt, is_malformed`` to rows of (row_number, element VARIANT).

    An element is well formed if it is an object whose ``prompt`` is a string. A missing,
    null or empty id becomes ``row-N``; other ids keep their JSON text form.
    """
    element = F.col("element")
    schema = F.schema_of_variant(element)
    kind = F.coalesce(F.substring_index(F.substring_index(schema, "<", 1), "(", 1), F.lit("UNPARSEABLE"))
    given = F.try_variant_get(element, "$.id", "string")
    prompt = F.try_variant_get(element, "$.prompt", "variant")
    has_prompt = F.coalesce(F.schema_of_variant(prompt) == "STRING", F.lit(False))
    return (
        elements.withColumn("kind", kind)
        .withColumn(
            "external_id",
            F.when(F.coalesce(given, F.lit("")) == "", row_label(F.col("row_number"))).otherwise(given),
        )
        .withColumn("prompt", F.when(has_prompt, F.try_variant_get(element, "$.prompt", "string")))
        .withColumn("is_malformed", F.col("prompt").isNull())
        .drop("element")
    )


def failure_text(is_malformed: Column, errors: Column) -> Column:
    """Text stored for a rejected row; null for an accepted one."""
    return F.when(is_malformed, MALFORMED).when(
        F.size(errors) > 0, F.concat(F.lit(PREFIX), F.array_join(errors, SEPARATOR))
    )
