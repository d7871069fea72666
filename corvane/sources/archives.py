"""Projects as archives: a zip of a project's files with a manifest, and back."""

from __future__ import annotations

import io
import json
import posixpath
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.sources.office import _reader

# fixed values: folders that an export takes by scope, names that it leaves out, the manifest's name
RESULT_FOLDERS = ("input", "output", "summary", "parsed", "validated", "converted", "projects", "solution")
OUTPUT_FOLDERS = ("output", "summary", "validated")
LEFT_OUT = (".workflow_state.json", ".docmind-progress.json", ".tmp", ".kb_state.json")
MANIFEST = "project_manifest.json"


def exported_files(files: DataFrame, scope: str = "results") -> DataFrame:
    """files(project, agent, folder, name, content) of the scope: results, outputs or all; hidden files and those that end like a name left out go."""
    folders = {"results": RESULT_FOLDERS, "outputs": OUTPUT_FOLDERS, "all": None}[scope]
    own = files if folders is None else files.where(F.col("folder").isin(*folders))
    bad = F.col("name").startswith(".")
    for n in LEFT_OUT:
        bad = bad | F.col("name").endswith(n)
    return own.where(~bad)


def manifests(files: DataFrame, scope: str = "results") -> DataFrame:
    """(project, manifest): agents with their folders and numbers of files, files and bytes in all, as JSON."""
    return _manifests(exported_files(files, scope), ["project"], scope)


def _manifests(own: DataFrame, keys: list[str], scope: str) -> DataFrame:
    per = own.groupBy(*keys, F.col("agent").alias("name")).agg(F.array_sort(F.collect_set("folder")).alias("folders"), F.count(F.lit(1)).alias("artifact_count"), F.sum(F.length("content")).alias("_bytes"))
    out = per.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("name", "folders", "artifact_count"))).alias("agents"), F.sum("artifact_count").alias("total_files"), F.sum("_bytes").alias("total_size_bytes"))
    body = F.struct(F.lit("1.0").alias("format_version"), F.col("project").alias("project_name"), F.lit(scope).alias("scope"), "agents", "total_files", "total_size_bytes")
    return out.select(*keys, F.to_json(body).alias("manifest"))


#: Bytes of files in a volume of an archive, about.
VOLUME = 16 << 20


def archives(files: DataFrame, scope: str = "results", volume: int = VOLUME) -> DataFrame:
    """(name, volume, content): an archive of each project. Files of more than `volume` bytes are dealt over volumes of about as many, each of them an archive with a manifest of its own; a volume must fit in a task."""
    import pandas as pd

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
            for r in pdf.sort_values(["agent", "folder", "name"]).itertuples(index=False):
                z.writestr(zipfile.ZipInfo(posixpath.join(key[0], r.agent, r.folder, r.name)), bytes(r.content))
            z.writestr(zipfile.ZipInfo(f"{key[0]}/{MANIFEST}"), pdf["manifest"].iloc[0])
        return pd.DataFrame({"name": [f"{key[0]}.zip"], "volume": [key[1]], "content": [buf.getvalue()]})

    own, keys = exported_files(files, scope).select("project", "agent", "folder", "name", "content"), ["project", "volume"]
    many = own.groupBy("project").agg(F.greatest(F.ceil(F.sum(F.length("content")) / volume), F.lit(1)).alias("_many"))
    own = own.join(many, "project").withColumn("volume", F.pmod(F.xxhash64("agent", "folder", "name"), F.col("_many")).cast("int")).drop("_many")
    return own.join(_manifests(own, keys, scope), keys).groupBy(*keys).applyInPandas(build, "name string, volume int, content binary")


def archive_entries(content: bytes) -> Iterator[tuple[str, str, int, bytes]]:
    """(project, name below the project, bytes, content); names that lead out of the project, and archives that are not as their manifest says, are errors."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = [n for n in z.namelist() if not n.endswith("/")]
        at = next((n for n in names if posixpath.basename(n) == MANIFEST and n.count("/") <= 1), None)
        manifest = json.loads(z.read(at)) if at else {}
        base = posixpath.dirname(at) if at else ""
        project = manifest.get("project_name") or base or "project"
        own = [n for n in names if n != at]
        for n in own:
            if n.startswith("/") or ".." in n.split("/"):
                raise ValueError(f"unsafe name: {n}")
        if manifest and manifest.get("total_files") != len(own):
            raise ValueError(f"{len(own)} files, {manifest.get('total_files')} in the manifest")
        for n in own:
            data = z.read(n)
            yield project, n.removeprefix(f"{base}/") if base else n, len(data), data


def read_archives(files: DataFrame) -> DataFrame:
    return _reader(files, archive_entries, "project:string;name:string;bytes:long;content:binary")
