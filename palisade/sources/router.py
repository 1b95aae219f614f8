"""Where a bundle comes from: the kind of a source text and the address it stands for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.text import base_name, extension
from palisade.operators.detect import TEXT_EXTENSIONS, TEXT_NAMES

# Prefixes of references and the addresses they stand for.
HUB, REGISTRY = "lobehub.com/skills/", "skills.sh/"
HUB_RAW = "https://raw.githubusercontent.com/lobehub/lobe-chat-agents/main/src/"
RAW, MARKER = "https://raw.githubusercontent.com/", "/main/SKILL.md"
REGISTRY_API = "https://skills.sh/api/skills/"
DEFAULT_NAME = "downloaded_skill.txt"


def local_kind(path: Column, is_folder: Column) -> Column:
    name, ext = base_name(path), extension(path)
    return (
        F.when(is_folder, "directory")
        .when(ext == "zip", "zip")
        .when(((ext == "gz") & name.endswith(".tar.gz")) | (ext == "tgz"), "tar")
        .when(ext.isin(*TEXT_EXTENSIONS) | name.isin(*TEXT_NAMES), "file")
        .otherwise("unsupported")
    )


def routed(sources: DataFrame) -> DataFrame:
    """sources (source, and local: 'file', 'directory' or null for what lies at this path) to (source, kind, address).

    Precedence: hub, registry, shorthand, http(s), local. The address of a registry reference is the one to fall back
    on when its API gives none."""
    s, parts = F.col("source"), F.split("source", "/")
    hub_name = F.get(F.split(F.regexp_replace("source", f"^({HUB.replace('.', '[.]')})+", ""), "/"), F.lit(0))
    owner = F.split(F.regexp_replace("source", f"^({REGISTRY.replace('.', '[.]')})+", ""), "/")
    shorthand = ~s.rlike("^[./\\\\]") & ~s.contains("://") & (F.size(parts) == 2) & s.rlike("^[^/.]+/[^/.]+$") & F.col("local").isNull()
    kind = (
        F.when(s.startswith(HUB), F.when(hub_name != "", "hub").otherwise("invalid"))
        .when(s.startswith(REGISTRY), F.when(F.size(owner) >= 2, "registry").otherwise("invalid"))
        .when(shorthand, "shorthand")
        .when(s.rlike("^https?://"), "url")
        .when(F.col("local").isNull(), "missing")
        .otherwise(local_kind(s, F.col("local") == "directory"))
    )
    address = (
        F.when(F.col("kind") == "hub", F.concat(F.lit(HUB_RAW), hub_name, F.lit("/SKILL.md")))
        .when(F.col("kind") == "registry", F.concat(F.lit(RAW), F.get(owner, F.lit(0)), F.lit("/"), F.get(owner, F.lit(1)), F.lit(MARKER)))
        .when(F.col("kind") == "shorthand", F.concat(F.lit(RAW), s, F.lit(MARKER)))
        .when(F.col("kind") == "url", s)
    )
    return sources.withColumn("kind", kind).withColumn("address", address).select("source", "kind", "address")


def registry_api(source: Column) -> Column:
    """Where a registry reference asks for its address."""
    owner = F.split(F.regexp_replace(source, f"^({REGISTRY.replace('.', '[.]')})+", ""), "/")
    return F.concat(F.lit(REGISTRY_API), F.get(owner, F.lit(0)), F.lit("/"), F.get(owner, F.lit(1)))


def registry_address(response: Column, fallback: Column) -> Column:
    """The address in a registry API's response, else the fallback; an address is a text."""
    found = F.try_variant_get(F.try_parse_json(response), "$.source_url", "variant")
    return F.coalesce(F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(F.try_parse_json(response), "$.source_url", "string")), fallback)


def file_name_of(url: Column) -> Column:
    name = F.regexp_extract(F.try_parse_url(url, F.lit("PATH")), "([^/]*)$", 1)
    return F.when(F.coalesce(name, F.lit("")) == "", DEFAULT_NAME).otherwise(name)
