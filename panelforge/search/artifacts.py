"""Candidate files, manifests and their publication."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = 4

_STRUCT = (
    "schema int, run_id string, expression string, fingerprint string, semantic_fingerprint string, structural_score double, score_schema int, "
    + ", ".join(f"{n} struct<simplicity:double,archive_novelty:double,family_diversity:double,lineage_diversity:double,structural_novelty:double,transform_diversity:double>" for n in ("score_components", "normalized_weights"))
    + ", structural_descriptor struct<operator_shingles:array<string>,operator_histogram:map<string,int>,ordered_paths:array<string>,fields:array<string>,field_families:array<string>,window_buckets:map<string,int>,"
    "groups:array<string>,nonlinear:boolean,conditional:boolean,lineage_parents:array<string>>, root_family string, nodes int, depth int, "
    "provenance struct<kind:string,operation:string,parent_fingerprints:array<string>,requested_operation:string,affected_path:string,old_subtree_fingerprint:string,new_subtree_fingerprint:string,retry_count:int>"
)


class ArtifactError(ValueError):
    pass


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Candidate JSONL of any size: blank lines are skipped, an unreadable line or a schema outside 1..4 is an error on use."""
    lines = spark.read.text(path).filter(F.trim("value") != "").select("value", "_metadata.file_path", F.from_json("value", _STRUCT).alias("r"))
    bad = F.col("r.schema").isNull() | ~F.col("r.schema").between(1, SCHEMA) | F.col("r.expression").isNull()
    checked = lines.withColumn("r", F.when(bad, F.raise_error(F.concat(F.lit("not a candidate: "), F.substring("value", 1, 200))).cast(lines.schema["r"].dataType)).otherwise(F.col("r")))
    return checked.select("r.*")


def write_candidates(df: DataFrame, path: str) -> None:
    """Candidates as JSON lines in a folder, written by the tasks that hold them; columns of other names are left out."""
    wanted = [c for c in df.sparkSession.createDataFrame([], _STRUCT).columns if c in df.columns]
    df.select(*wanted).write.json(path)


def load_candidates(path: str) -> tuple[list[dict], str]:
    """Records of a small file in their order, with the SHA-256 of its bytes; errors name the line."""
    with open(path, "rb") as f:
        data = f.read()
    out = []
    for i, line in enumerate(data.decode("utf-8").splitlines(), 1):
        if not line.strip():
            continue
        try:
            r = json.loads(line)
        except json.JSONDecodeError as e:
            raise ArtifactError(f"line {i}: {e}") from e
        if not isinstance(r, dict) or not 1 <= r.get("schema", 0) <= SCHEMA or "expression" not in r:
            raise ArtifactError(f"line {i}: unsupported candidate schema")
        out.append(r)
    return out, hashlib.sha256(data).hexdigest()


def write_atomically(path: str, data: bytes, overwrite: bool = True) -> str:
    """Temporary file, fsync, rename; the SHA-256 of what was written."""
    if not overwrite and os.path.exists(path):
        raise ArtifactError(f"{path} exists")
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    fd, temporary = tempfile.mkstemp(dir=folder, prefix=".tmp-")
    try:
        with os.fdopen(fd, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, path)
    except BaseException:
        if os.path.exists(temporary):
            os.unlink(temporary)
        raise
    return hashlib.sha256(data).hexdigest()


def dumps(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"))


def write_jsonl(path: str, records: list[dict], overwrite: bool = True) -> str:
    return write_atomically(path, "".join(dumps(r) + "\n" for r in records).encode(), overwrite)


def write_json(path: str, value: object, overwrite: bool = True) -> str:
    return write_atomically(path, (dumps(value) + "\n").encode(), overwrite)


def publish(out: str, records: list[dict], manifest: dict) -> dict:
    """An immutable pair of files under ``.OUT.runs``, then the pointer to it, then the plain names.

    A reader that follows the pointer never sees one run's candidates with another's manifest.
    """
    run_id = manifest["run_id"]
    if any(r.get("run_id") != run_id for r in records):
        raise ArtifactError("candidates and manifest are of different runs")
    lines = "".join(dumps(r) + "\n" for r in records).encode()
    manifest = {**manifest, "candidates_sha256": hashlib.sha256(lines).hexdigest()}
    body = (dumps(manifest) + "\n").encode()
    sums = (manifest["candidates_sha256"], hashlib.sha256(body).hexdigest())
    folder, name = os.path.dirname(os.path.abspath(out)), os.path.basename(out)
    pair = os.path.join(folder, f".{name}.runs", f"{run_id[:16]}-{sums[0][:16]}-{sums[1][:16]}")
    if not os.path.exists(os.path.join(pair, "manifest.json")):
        write_atomically(os.path.join(pair, "candidates.jsonl"), lines)
        write_atomically(os.path.join(pair, "manifest.json"), body)
    pointer = {"schema": 1, "run_id": run_id, "directory": os.path.relpath(pair, folder), "candidates_sha256": sums[0], "manifest_sha256": sums[1]}
    write_json(f"{out}.current.json", pointer)
    write_atomically(out, lines)
    write_atomically(f"{out}.manifest.json", body)
    return pointer


def read_published(out: str) -> tuple[list[dict], dict]:
    """Candidates and manifest of the published run, both checked against the pointer."""
    with open(f"{out}.current.json", encoding="utf-8") as f:
        pointer = json.load(f)
    folder = os.path.join(os.path.dirname(os.path.abspath(out)), pointer["directory"])
    records, sha = load_candidates(os.path.join(folder, "candidates.jsonl"))
    with open(os.path.join(folder, "manifest.json"), "rb") as f:
        body = f.read()
    manifest = json.loads(body)
    if sha != pointer["candidates_sha256"] or hashlib.sha256(body).hexdigest() != pointer["manifest_sha256"]:
        raise ArtifactError("published files don't match the pointer")
    if manifest["run_id"] != pointer["run_id"] or any(r["run_id"] != manifest["run_id"] for r in records):
        raise ArtifactError("published files are of different runs")
    return records, manifest
