"""The persisted state: five Parquet tables and a manifest.

A version is written into a folder of its own, then published by one rename of its
manifest to the next free number, which replaces nothing: a reader takes the manifest
with the highest number and sees a whole version or the one before. The manifest holds
the rows and a checksum of each table. A manifest of another format, other zones, another
source, or with a missing, damaged or altered table is refused. KEPT versions stay, for
readers that opened them; older ones are deleted.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..constants import KIND_LABELS, KINDS, MAX_TAG_BYTES
from ..operators import zones

FORMAT, VERSION = "cartolith", 1
KEPT = 2
TABLES = {"nodes": schemas.NODES, "edges": schemas.EDGES, "cameras": schemas.CAMERAS, "places": schemas.PLACES, "occluders": schemas.OCCLUDERS}


class LoadFailed(Exception):
    """The stored state cannot be used; the text says why."""


@dataclass
class Parts:
    nodes: DataFrame
    edges: DataFrame
    cameras: DataFrame
    places: DataFrame
    occluders: DataFrame


def fingerprint(spark: SparkSession, path: str) -> str:
    """Of a source's content, in whatever files (of less than 2 GB each) it lies. The
    executors hash the files; the driver gets one row a file."""
    rows = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha")).orderBy("path").collect()
    return hashlib.sha256("".join(r["sha"] for r in rows).encode()).hexdigest()


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def proof(df: DataFrame) -> dict[str, str]:
    """Rows, and a sum over hashes of rows, which does not depend on their order."""
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(20,0)")).alias("s")).first()
    return {"rows": str(row["n"]), "checksum": str(row["s"] or 0)}


def _manifests(spark: SparkSession, path: str) -> list[int]:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(m[1]) for m in (re.fullmatch(r"manifest-(\d+)\.json", n) for n in names) if m)


def write(parts: Parts, path: str, source: str, **provenance: str) -> None:
    spark = parts.nodes.sparkSession
    folder = uuid.uuid4().hex
    proofs = {}
    for name, schema in TABLES.items():
        df: DataFrame = getattr(parts, name)
        df.select(*[f.name for f in _struct(spark, schema)]).write.parquet(f"{path}/{folder}/{name}")
        proofs[name] = proof(spark.read.schema(schema).parquet(f"{path}/{folder}/{name}"))
    body = {"format": FORMAT, "version": VERSION, "source": source, "zones": zones.signature(), "tables": folder, "proofs": proofs, "provenance": provenance}
    fs, tmp = _fs(spark, f"{path}/manifest.{folder}")
    out = fs.create(tmp, True)
    out.write(bytearray(json.dumps(body).encode()))
    out.close()
    for number in range(max(_manifests(spark, path), default=0) + 1, 1 << 31):
        _, final = _fs(spark, f"{path}/manifest-{number}.json")
        if not fs.exists(final) and fs.rename(tmp, final):
            break
        if not fs.exists(final):
            raise OSError(f"{path}: the manifest could not be renamed")
    for old in _manifests(spark, path)[:-KEPT]:
        try:
            gone = _text(spark, f"{path}/manifest-{old}.json").get("tables")
        except ValueError:  # damaged: its tables cannot be told
            gone = None
        fs.delete(_fs(spark, f"{path}/manifest-{old}.json")[1], False)
        if gone:
            fs.delete(_fs(spark, f"{path}/{gone}")[1], True)


def write_quietly(parts: Parts, path: str, source: int, **provenance: str) -> bool:
    """write(), where a failure only means that nothing is stored."""
    try:
        write(parts, path, source, **provenance)
        return True
    except Exception:
        return False


def _struct(spark: SparkSession, ddl: str):
    return spark.createDataFrame([], ddl).schema


def _text(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r[0] for r in spark.read.text(path).collect()))


def manifest(spark: SparkSession, path: str) -> dict:
    try:
        found = _text(spark, f"{path}/manifest-{_manifests(spark, path)[-1]}.json")
    except Exception as e:
        raise LoadFailed("no readable manifest") from e
    if not isinstance(found, dict) or found.get("format") != FORMAT:
        raise LoadFailed("not a store of this engine")
    if found.get("version") != VERSION:
        raise LoadFailed(f"format version {found.get('version')}, not {VERSION}")
    return found


def read(spark: SparkSession, path: str, source: str | None = None) -> Parts:
    """The stored tables, each read once against its proof. source: the fingerprint
    they must come from, if any."""
    found = manifest(spark, path)
    if found.get("zones") != zones.signature():
        raise LoadFailed("scored with other zones")
    if source is not None and found.get("source") != source:
        raise LoadFailed("made from another source")
    tables = {}
    for name, schema in TABLES.items():
        where = f"{path}/{found.get('tables')}/{name}"
        try:
            fs, p = _fs(spark, f"{where}/_SUCCESS")
            if not fs.exists(p):
                raise LoadFailed(f"{name} is not whole")
            stored = spark.read.parquet(where)
            want = _struct(spark, schema)
            if [(f.name, f.dataType) for f in stored.schema] != [(f.name, f.dataType) for f in want]:
                raise LoadFailed(f"{name} has other columns")
            if proof(stored) != (found.get("proofs") or {}).get(name):
                raise LoadFailed(f"{name} is not what was written")
        except LoadFailed:
            raise
        except Exception as e:
            raise LoadFailed(f"{name} is damaged") from e
        tables[name] = stored
    one_of = lambda c, *values: F.coalesce(F.col(c).isin(*values), F.lit(False))
    long = lambda c: F.coalesce(F.octet_length(c) > MAX_TAG_BYTES, F.lit(False))
    bad = tables["cameras"].where(~one_of("kind", *KINDS) | long("manufacturer") | long("model"))
    if not bad.isEmpty() or not tables["places"].where(~one_of("kind", *KIND_LABELS)).isEmpty():
        raise LoadFailed("a value is outside its range")
    return Parts(**tables)


def dates(provenance: DataFrame) -> DataFrame:
    """key, day of the entries (key, value) that begin with a date."""
    return provenance.select("key", F.expr("try_cast(left(value, 10) as date)").alias("day")).where("day is not null")


def built_on(spark: SparkSession, path: str) -> DataFrame:
    """Dates of the provenance."""
    return dates(spark.createDataFrame(list(manifest(spark, path).get("provenance", {}).items()), "key string, value string"))
