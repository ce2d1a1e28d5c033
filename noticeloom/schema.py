"""The canonical notice and the projection of any source to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DateType, DecimalType, StringType, StructField, StructType, TimestampType

_OTHER = {
    "due_date": DateType(),
    "posted_date": DateType(),
    "keywords": ArrayType(StringType()),
    "budget_amount": DecimalType(20, 2),
    "attachments": ArrayType(StructType([StructField("name", StringType()), StructField("url", StringType())])),
    "translation_incomplete": BooleanType(),
    "event_period": StructType([StructField("start", DateType()), StructField("end", DateType())]),
    "first_seen_at": TimestampType(),
}
_NAMES = (
    "id source_code source title org country country_code region status due_date posted_date keywords classification_status notice_type "
    "budget_amount budget_currency budget_display contract_method delivery_condition payment_condition eligibility description attachments url "
    "original_url translated_title original_title translated_summary original_summary original_org translation_incomplete source_country source_type "
    "source_site_url detected_language event_period project_no national_bid_no first_seen_at"
).split()

#: Key: (source_code, id).
NOTICE = StructType([StructField(n, _OTHER.get(n, StringType())) for n in _NAMES])


def project(rows: DataFrame, **fields: Column) -> DataFrame:
    """All fields of the canonical notice; what a source doesn't give is null. Unknown names are an error."""
    if unknown := set(fields) - set(_NAMES):
        raise ValueError(f"no such fields: {sorted(unknown)}")
    return rows.select(*(fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in NOTICE))
