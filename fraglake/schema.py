"""Schemas of reads, store tables and the logical value types."""

from __future__ import annotations

from pyspark.sql import types as T

READS = T.StructType(
    [
        T.StructField("sample_id", T.StringType()),
        T.StructField("qname", T.StringType()),
        T.StructField("flag", T.IntegerType()),
        T.StructField("chrom", T.StringType()),
        T.StructField("reference_start", T.LongType()),
        T.StructField("reference_end", T.LongType()),
        T.StructField("mapq", T.IntegerType()),
        T.StructField("cigar", T.StringType()),
        T.StructField("template_length", T.LongType()),
        T.StructField("query_length", T.IntegerType()),
        T.StructField("query_sequence", T.StringType()),
    ]
)

#: Bits of the SAM flag: fixed values.
PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE, READ1, READ2, SECONDARY, QCFAIL, DUPLICATE, SUPPLEMENTARY = (1 << i for i in range(12))
#: Unmapped, mate unmapped, secondary, failed, duplicate, supplementary.
EXCLUDED = UNMAPPED | MATE_UNMAPPED | SECONDARY | QCFAIL | DUPLICATE | SUPPLEMENTARY

#: Logical types of the feature store in the order in which a later one wins, and what holds them (no unsigned types in Spark: one step wider).
VALUE_TYPES = {
    "UInt8": "smallint", "UInt16": "int", "UInt32": "bigint", "Int8": "tinyint", "Int16": "smallint", "Int32": "int", "Int64": "bigint",
    "Float32": "float", "Float64": "double", "Bool": "boolean", "Date": "date", "DateTime": "timestamp", "String": "string",
}
INTEGER_BOUNDS = {
    "UInt8": (0, 2**8 - 1), "UInt16": (0, 2**16 - 1), "UInt32": (0, 2**32 - 1),
    "Int8": (-(2**7), 2**7 - 1), "Int16": (-(2**15), 2**15 - 1), "Int32": (-(2**31), 2**31 - 1), "Int64": (-(2**63), 2**63 - 1),
}
NUMERIC_TYPES = (*INTEGER_BOUNDS, "Float32", "Float64")
