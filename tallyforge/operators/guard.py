"""Policy rules over file manifests (path, content)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge import schemas as S
from tallyforge.functions import all_tokens, any_token, file_name, file_suffix, sha256_hex


def path_violations(manifest: DataFrame) -> DataFrame:
    """(repo, path, violation): one row per broken path rule; a path may break several."""
    low = F.lower("path")
    name = file_name(low)
    rules = [
        (name == S.SECRET_NAME, S.SECRET_FILE),
        (name.startswith(S.ENV_PREFIX) & (name != S.ENV_EXAMPLE), S.ENV_FILE),
        (any_token(low, S.SECRET_PARTS), S.CREDENTIAL_PATH),
        (name.isin(*S.KEY_NAMES) | file_suffix(name).isin(*S.KEY_SUFFIXES) | name.rlike("^(" + "|".join(S.KEY_PREFIXES) + ")"), S.KEY_FILE),
    ]
    found = F.array_compact(F.array(*[F.when(broken, said) for broken, said in rules]))
    return manifest.select("repo", "path", F.explode(found).alias("violation"))


def content_violations(manifest: DataFrame, scanner: str | None = None) -> DataFrame:
    """(repo, path, violation): texts with all three conflict tokens; binary files, nulls and the scanner are skipped."""
    skipped = file_suffix(F.lower(file_name(F.col("path")))).isin(*S.BINARY_SUFFIXES)
    rows = manifest.where(~skipped & all_tokens(F.col("content"), S.CONFLICT_TOKENS))
    if scanner:
        rows = rows.where(F.col("path") != scanner)
    return rows.select("repo", "path", F.lit(S.MERGE_MARKERS).alias("violation"))


def missing_required(manifest: DataFrame, required: DataFrame) -> DataFrame:
    """(repo, path, violation) of required paths (repo, path) that the manifest lacks, in order of path."""
    out = required.join(manifest.select("repo", "path").distinct(), ["repo", "path"], "left_anti")
    return out.select("repo", "path", F.lit(S.FILE_MISSING).alias("violation")).orderBy("repo", "path")


def missing_owner(manifest: DataFrame, rules: DataFrame) -> DataFrame:
    """(repo, path, violation): rules (repo, path, token) whose file lacks the token, or is absent."""
    out = rules.join(manifest, ["repo", "path"], "left")
    lacks = ~F.coalesce(F.contains("content", "token"), F.lit(False))
    return out.where(lacks).select("repo", "path", F.lit(S.OWNER_MISSING).alias("violation"))


def guard_verdict(violations: DataFrame, manifest: DataFrame) -> DataFrame:
    """(repo, verdict, n_violations, n_files): BLOCK if there is any violation."""
    bad = violations.groupBy("repo").agg(F.count("*").alias("n_violations"))
    out = manifest.groupBy("repo").agg(F.count("*").alias("n_files")).join(bad, "repo", "full").fillna(0)
    return out.select("repo", F.when(F.col("n_violations") > 0, "BLOCK").otherwise("PASS").alias("verdict"), "n_violations", "n_files")


def checksum_manifest(manifest: DataFrame) -> DataFrame:
    """(path, line): SHA-256 in lower-case hex, two spaces, file name."""
    return manifest.select("path", F.concat_ws("  ", sha256_hex(F.col("content")), file_name(F.col("path"))).alias("line"))


def read_files(spark: SparkSession, path: str, repo: str = "") -> DataFrame:
    """Manifest (repo, path, content) of all files below path; content is null where it isn't UTF-8."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    return rows.select(F.lit(repo).alias("repo"), F.trim("path").alias("path"), text.alias("content")).where("path <> ''")
