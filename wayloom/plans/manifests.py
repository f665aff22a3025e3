"""Manifests made of parts: a file for each brand, an entry for each part, with every fault that drops an entry or a file."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import manifest as M
from .base import query, table

GOOD = {"name": '"p-{k}"', "kind": '"region"', "title": '{"uk":" ","en":"T"}', "bbox": "[1,2,3.5,4]", "url": '"packs/p-{k}.roadpack"', "size": "5.0", "sha256": '"' + "0" * 64 + '"', "contentHash": '"' + "a" * 16 + '"', "formatVersion": "1", "osmTimestamp": "7"}
#: Fields changed (None: left out) and the reason; an entry's number modulo their count says which.
FAULTS: list[tuple[dict, str | None]] = [
    ({}, None), ({"": "7"}, "notAnObject"), ({"name": None}, "missingField:name"), ({"name": "null"}, "mistypedField:name"), ({"name": '"Bad Name"'}, "invalidName:Bad Name"), ({"kind": '"city"'}, "unknownKind:city"), ({"title": '{"uk":"x"}'}, "missingField:title.en"),
    ({"title": '{"uk":1,"en":""}'}, "mistypedField:title.uk"), ({"title": '{"uk":" ","en":"\\u00a0"}'}, "emptyTitles"), ({"bbox": '[1,2,"3",4]'}, "mistypedField:bbox"), ({"bbox": "[1,2,3]"}, "invalidBBox"), ({"bbox": "[5,2,3,4]"}, "invalidBBox"),
    ({"url": '"https:///x"'}, "invalidURL:https:///x"), ({"url": '"http://maps.example/x"'}, "notHTTPS:http://maps.example/x"), ({"url": '"//other.example/x"'}, "otherHost://other.example/x"), ({"url": '"HTTPS://u@Maps.Example:443/x"'}, None), ({"size": "0"}, "invalidSize:0"), ({"size": "1.5"}, "mistypedField:size"),
    ({"sha256": '"0"'}, "invalidSHA256"), ({"contentHash": '"A"'}, "invalidContentHash"), ({"formatVersion": "9"}, "unsupportedFormatVersion:9"), ({"osmDate": "3"}, "mistypedField:osmDate"), ({"name": '"same"'}, None), ({"url": '" "'}, "invalidURL: "),
]
HEAD = '"generated":"g","license":"l","licenseUrl":"u","attribution":"a"'


def _entry(change: dict) -> str:
    if "" in change:
        return change[""]
    return "{" + ",".join(f'"{n}":{v}' for n, v in (GOOD | change).items() if v is not None) + "}"


_D = f"p_partkey % {len(FAULTS)}"
_REASON = "CASE " + " ".join(f"WHEN {_D} = {i} THEN '{r}'" for i, (_, r) in enumerate(FAULTS) if r) + " END"
_NAME = f"CASE WHEN {_D} IN (1, 2, 3) THEN NULL WHEN {_D} = 4 THEN 'Bad Name' WHEN {_D} = 22 THEN 'same' ELSE 'p-' || p_partkey END"


@query("manifest_packs", f"""
WITH e AS (SELECT p_brand AS file, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS idx, {_NAME} AS name, {_REASON} AS reason FROM part WHERE CAST(right(p_brand, 1) AS INT) < 4)
SELECT file, idx, name, CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY file, name, reason IS NULL ORDER BY idx) > 1 THEN 'duplicateName' ELSE reason END AS reason FROM e""")
def manifest_packs(spark, sf):
    return M.read(_files(spark, sf))[1].select("file", F.col("idx").cast("long").alias("idx"), "name", "reason")


@query("manifest_failures", """
SELECT DISTINCT p_brand AS file, CASE right(p_brand, 2) WHEN '14' THEN 'missingField:schema' WHEN '24' THEN 'mistypedField:packs' WHEN '34' THEN 'unsupportedSchema' WHEN '44' THEN 'missingField:license' WHEN '54' THEN 'notJSON' WHEN '15' THEN 'mistypedField:schema' ELSE CASE WHEN CAST(right(p_brand, 1) AS INT) >= 4 THEN 'notJSON' END END AS failure FROM part""")
def manifest_failures(spark, sf):
    return M.read(_files(spark, sf))[0]


def _files(spark, sf):
    k = F.col("p_partkey")
    text = F.replace(F.element_at(F.array(*(F.lit(_entry(c)) for c, _ in FAULTS)), (k % len(FAULTS) + 1).cast("int")), F.lit("{k}"), k.cast("string"))
    parts = table(spark, sf, "part").select(F.col("p_brand").alias("file"), F.struct(k.alias("k"), text.alias("e")).alias("x"))
    packs = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x.e), ",")  # a brand's parts: a manifest's entries
    files = parts.groupBy("file").agg(packs.alias("packs"))
    two, one = F.substring("file", -2, 2), F.substring("file", -1, 1).cast("int")
    whole = lambda schema, head=HEAD: F.concat(F.lit("{" + schema + head + ',"packs":['), F.col("packs"), F.lit("]}"))
    value = (
        F.when(one < 4, whole('"schema":2,')).when(two == "14", whole("")).when(two == "24", F.lit('{"schema":2,' + HEAD + ',"packs":{}}')).when(two == "34", whole('"schema":3,'))
        .when(two == "44", whole('"schema":2,', '"generated":"g","licenseUrl":"u","attribution":"a"')).when(two == "15", whole('"schema":"2",')).when(two == "25", F.lit("[]")).otherwise(F.lit("{nonsense"))
    )
    return files.select("file", F.lit("maps.example").alias("host"), value.alias("value"))
