"""Catalogs as tables. Input: artifact_id, body."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields of catalogs.
_TABLE = "struct<unique_id:string,metadata:struct<type:string,schema:string,name:string,database:string,comment:string,owner:string>,columns:map<string,struct<type:string,index:bigint,name:string,comment:string>>,stats:map<string,struct<id:string,label:string,value:variant,include:boolean,description:string>>>"
CATALOG = f"nodes map<string,{_TABLE}>, sources map<string,{_TABLE}>, errors array<string>"


def catalog_tables(docs: DataFrame) -> DataFrame:
    """A row for each table: origin (nodes or sources), unique_id (its key), metadata, columns, stats."""
    def listed(origin: str) -> Column:
        return F.transform(F.coalesce(F.map_entries(F.col(f"c.{origin}")), F.array()), lambda e: F.struct(F.lit(origin).alias("origin"), e["key"].alias("unique_id"), e["value"].alias("t")))

    got = docs.select("artifact_id", F.from_json("body", CATALOG).alias("c"))
    each = got.select("artifact_id", F.inline(F.concat(listed("nodes"), listed("sources"))))
    return each.select("artifact_id", "origin", "unique_id", "t.metadata.*", "t.columns", "t.stats")


def catalog_columns(docs: DataFrame) -> DataFrame:
    each = catalog_tables(docs).select("artifact_id", "origin", "unique_id", F.explode("columns").alias("column", "c"))
    return each.select("artifact_id", "origin", "unique_id", "column", "c.type", "c.index", "c.comment")


def catalog_stats(docs: DataFrame) -> DataFrame:
    """A row for each statistic; value as text, and as a number where it is one."""
    each = catalog_tables(docs).select("artifact_id", "origin", "unique_id", F.explode("stats").alias("stat", "s"))
    kind = F.schema_of_variant("s.value")
    number = F.when(kind.rlike("BIGINT|DECIMAL|DOUBLE"), F.try_variant_get("s.value", "$", "double"))
    return each.select("artifact_id", "origin", "unique_id", "stat", "s.label", "s.include", "s.description", kind.alias("value_kind"), F.try_variant_get("s.value", "$", "string").alias("value"), number.alias("number"))


def catalog_errors(docs: DataFrame) -> DataFrame:
    return docs.select("artifact_id", F.posexplode(F.from_json("body", CATALOG)["errors"]).alias("pos", "error"))
