"""SQL Server values from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Declared types by how they are converted.
KINDS = {
    "bit": "boolean", "tinyint": "int", "smallint": "int", "int": "int", "bigint": "bigint", "real": "double", "float": "double", "decimal": "string", "numeric": "string", "money": "string", "smallmoney": "string",
    "binary": "binary", "varbinary": "binary", "image": "binary", "rowversion": "binary", "timestamp": "binary", "geometry": "binary", "geography": "binary", "uniqueidentifier": "uuid",
    "date": "string", "time": "string", "datetime": "datetime", "datetime2": "datetime", "smalldatetime": "datetime", "datetimeoffset": "datetime", "char": "string", "varchar": "string", "nchar": "string",
    "nvarchar": "string", "text": "string", "ntext": "string", "xml": "string", "hierarchyid": "string",
}


def value(text: Column, source_type: str) -> Column:
    kind = KINDS.get(source_type.strip().lower().split("(")[0], "string")
    if kind == "boolean":
        return F.when(F.lower(text).isin("1", "true"), True).when(F.lower(text).isin("0", "false"), False)
    if kind == "binary":
        return F.unhex(F.regexp_replace(text, "^0[xX]", ""))
    if kind == "uuid":
        return F.lower(text)
    if kind == "datetime":
        return F.regexp_replace(text, "^(\\d{4}-\\d{2}-\\d{2}) ", "$1T")
    return text.try_cast(kind)
