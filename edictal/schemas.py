"""Explicit schemas; nothing is ever inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {
    "int": T.IntegerType(), "long": T.LongType(), "string": T.StringType(), "double": T.DoubleType(),
    "ntz": T.TimestampNTZType(), "date": T.DateType(), "bool": T.BooleanType(),
    "floats": T.ArrayType(T.FloatType()),
}


def _schema(text: str) -> T.StructType:
    fields = (item.split(":") for item in text.split())
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in fields])


TABLES = {
    "region": _schema("r_regionkey:int r_name:string"),
    "nation": _schema("n_nationkey:int n_name:string n_regionkey:int"),
    "customer": _schema("c_custkey:long c_name:string c_nationkey:int c_acctbal:double c_mktsegment:string"),
    "supplier": _schema("s_suppkey:long s_name:string s_nationkey:int s_acctbal:double"),
    "part": _schema("p_partkey:long p_name:string p_brand:string p_type:string p_size:int p_retailprice:double"),
    "orders": _schema(
        "o_orderkey:long o_custkey:long o_orderstatus:string o_totalprice:double o_orderdate:ntz o_orderpriority:string"
    ),
    "lineitem": _schema(
        "l_orderkey:long l_partkey:long l_suppkey:long l_linenumber:int l_quantity:double l_extendedprice:double "
        "l_discount:double l_tax:double l_returnflag:string l_linestatus:string l_shipdate:ntz"
    ),
    "events": _schema("event_id:long ts:ntz user_id:long event_type:string value:double props:string"),
    "documents": _schema("doc_id:long text:string lang:string source:string n_chars:long"),
    "labels": _schema("doc_id:long quality:int toxic:int"),
    "pages": _schema("page_id:long url:string html:string"),
    "benchmark": _schema("item_id:long text:string"),
    "conversations": _schema("conv_id:long turn:long role:string text:string"),
    "embeddings": _schema("vec_id:long embedding:floats label:int"),
}

MUNICIPALITIES = _schema("codigo_ine:string nombre:string nombre_val:string")

# The daily summary of the state gazette, as far as it is read.
ITEM = T.StructType([T.StructField(c, T.StringType()) for c in ("identificador", "titulo", "url_html", "url_pdf")])
