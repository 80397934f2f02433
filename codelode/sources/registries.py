"""Package registries: saved responses as package rows.

``read`` turns rows (registry, value) into (registry, name, version,
description, homepage, repository, license, downloads). A JSON registry is a
set of paths, so a new one is a line of data; text registries are stanzas of
``key: value`` lines or of ``key = value`` lines. Fetching is the caller's
business: responses are read from files, which also serve as the cache
(``fresh_or_stale``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ("name", "version", "description", "homepage", "repository", "license", "downloads")

# fixed values: where the public interfaces keep each field (several places: the first that is there)
JSON_PATHS = {
    "pip": ("$.info.name", "$.info.version", "$.info.summary", "$.info.home_page|$.info.project_urls.Homepage", "$.info.project_urls.Source|$.info.project_urls.Repository", "$.info.license", ""),
    "npm": ("$.name", "$.dist-tags.latest|$.version", "$.description", "$.homepage", "$.repository.url", "$.license", "$.downloads"),
    "cargo": ("$.crate.name", "$.crate.max_stable_version|$.crate.max_version", "$.crate.description", "$.crate.homepage", "$.crate.repository", "$.versions[0].license", "$.crate.downloads"),
    "gem": ("$.name", "$.version", "$.info", "$.homepage_uri", "$.source_code_uri", "$.licenses[0]", "$.downloads"),
    "hex": ("$.name", "$.latest_stable_version|$.latest_version", "$.meta.description", "$.html_url", "$.meta.links.GitHub", "$.meta.licenses[0]", "$.downloads.all"),
    "composer": ("$.package.name", "$.package.version", "$.package.description", "$.package.homepage", "$.package.repository", "$.package.license[0]", "$.package.downloads.total"),
    "pub": ("$.name", "$.latest.version", "$.latest.pubspec.description", "$.latest.pubspec.homepage", "$.latest.pubspec.repository", "", ""),
    "nuget": ("$.id", "$.version", "$.description|$.summary", "$.projectUrl", "", "$.licenseExpression|$.licenseUrl", "$.totalDownloads"),
    "maven": ("$.id", "$.latestVersion|$.v", "", "", "", "", ""),
    "go": ("$.Path|$.Origin.URL", "$.Version", "", "", "$.Origin.URL", "", ""),
    "brew": ("$.name", "$.versions.stable", "$.desc", "$.homepage", "$.urls.head.url", "$.license", "$.analytics.install.365d.*"),
    "homebrew_casks": ("$.token", "$.version", "$.desc", "$.homepage", "", "", ""),
    "jsr": ("$.name", "$.latestVersion", "$.description", "", "$.githubRepository.name", "", ""),
    "deno": ("$.name", "$.latest_version|$.version", "$.description", "", "$.upload_options.repository", "", "$.star_count"),
    "cran": ("$.Package", "$.Version", "$.Title|$.Description", "$.URL", "", "$.License", ""),
    "cpan": ("$.distribution|$.name", "$.version", "$.abstract", "$.resources.homepage", "$.resources.repository.url", "$.license[0]", ""),
    "clojars": ("$.jar_name", "$.latest_release|$.latest_version", "$.description", "$.homepage", "$.scm.url", "$.licenses[0].name", "$.downloads"),
    "hackage": ("$.name", "$.version", "$.synopsis", "$.homepage", "", "$.license", ""),
    "dub": ("$.name", "$.version", "$.info.description|$.description", "$.info.homepage", "$.repository.project", "$.info.license", ""),
    "julia": ("$.name", "$.version", "", "", "$.repo", "", ""),
    "conda": ("$.name", "$.latest_version|$.version", "$.summary", "$.home|$.html_url", "$.dev_url", "$.license", "$.ndownloads"),
    "flatpak": ("$.id|$.flatpakAppId", "$.version|$.currentReleaseVersion", "$.summary", "$.urls.homepage|$.homepageUrl", "", "$.project_license", ""),
    "snap": ("$.name", "$.channel-map[0].version", "$.snap.summary", "$.snap.website", "", "$.snap.license", ""),
    "fdroid": ("$.packageName", "$.packages[0].versionName", "", "", "", "", ""),
    "scoop": ("$.name", "$.version", "$.description", "$.homepage", "", "$.license|$.license.identifier", ""),
    "vcpkg": ("$.Name|$.name", "$.Version|$.version", "$.Description|$.description", "$.Homepage|$.homepage", "", "$.License|$.license", ""),
    "nimble": ("$.name", "$.version", "$.description", "$.web", "$.url", "$.license", ""),
    "racket": ("$.name", "$.version", "$.description", "", "$.source", "$.license", ""),
    "nix": ("$.package_attr_name|$.pname", "$.package_pversion|$.version", "$.package_description|$.description", "$.package_homepage[0]|$.homepage", "", "$.package_license[0].fullName", ""),
    "guix": ("$.name", "$.version", "$.synopsis", "$.homepage", "", "", ""),
    "ctan": ("$.id|$.name", "$.version.number", "$.caption", "$.home", "$.repository", "$.license|$.license[0]", ""),
    "docker": ("$.name", "$.tag|$.last_updated", "$.description", "", "", "", "$.pull_count"),
    "macports": ("$.name", "$.version", "$.description", "$.homepage", "", "$.license", ""),
    "void": ("$.name", "$.version", "$.short_desc", "$.homepage", "", "$.license", ""),
    "conan": ("$.name", "$.version", "$.description", "$.homepage", "$.url", "$.license", ""),
    "copr": ("$.full_name|$.name", "$.version", "$.description", "$.homepage", "", "", ""),
    "opam": ("$.name", "$.version", "$.synopsis", "$.homepage", "$.dev-repo", "$.license", ""),
    "winget": ("$.PackageIdentifier|$.Id", "$.PackageVersion|$.Versions[0]", "$.ShortDescription|$.Latest.Description", "$.Homepage|$.Latest.Homepage", "", "$.License|$.Latest.License", ""),
    "termux": ("$.name", "$.version", "$.description", "$.homepage", "", "$.license", ""),
    "choco": ("$.Id", "$.Version", "$.Summary|$.Description", "$.ProjectUrl", "", "$.LicenseUrl", "$.DownloadCount"),
    "luarocks": ("$.package|$.name", "$.version", "$.description.summary", "$.description.homepage", "$.source.url", "$.description.license", ""),
    "gentoo": ("$.atom|$.name", "$.version", "$.description", "$.homepage", "", "$.license", ""),
    "slackware": ("$.name", "$.version", "$.description", "$.homepage", "", "", ""),
    "hunter": ("$.name", "$.version", "", "", "$.url", "", ""),
}

# fixed values: keys of stanzas
STANZA_KEYS = {
    **dict.fromkeys(("apt", "ubuntu"), ("Package", "Version", "Description", "Homepage", "Vcs-Browser", "License", "")),
    **dict.fromkeys(("pacman", "artix", "cachyos", "chaotic-aur", "endeavouros", "manjaro", "msys2"), ("NAME", "VERSION", "DESC", "URL", "", "LICENSE", "")),
    **dict.fromkeys(("dnf", "opensuse"), ("Name", "Version", "Summary", "URL", "", "License", "")),
    "apk": ("P", "V", "T", "U", "", "L", ""),
    "freebsd": ("name", "version", "comment", "www", "", "licenses", ""),
    "bioconductor": ("Package", "Version", "Title", "URL", "git_url", "License", ""),
}
REGISTRIES = (*JSON_PATHS, *STANZA_KEYS)


def _json(paths: str) -> Column:
    found = [F.nullif(F.get_json_object("value", p), F.lit("")) for p in paths.split("|") if p]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def _stanza(key: str, form: str) -> Column:
    if not key:
        return F.lit(None).cast("string")
    pattern = rf"(?m)^%{key}%\n([^\n]*)" if form == "percent" else rf"(?m)^{key}:[ \t]*([^\n]*)"
    return F.nullif(F.trim(F.regexp_extract("value", pattern, 1)), F.lit(""))


def read_index(spark: SparkSession, path: str | list[str], registry: str) -> DataFrame:
    """Packages of whole index files: stanzas parted by empty lines, or RPM metadata (``primary.xml``).

    A file is split at record borders into as many tasks as its size asks for:
    the text source's line delimiter is what ends a record. No file is read
    whole by one task.
    """
    if registry in ("dnf", "opensuse") and str(path if isinstance(path, str) else path[0]).endswith(".xml"):
        return _rpm(spark, path, registry)
    if registry not in STANZA_KEYS:
        raise ValueError(f"{registry} has no index of stanzas")
    return read(spark.read.option("lineSep", "\n\n").text(path), registry)


def _rpm(spark: SparkSession, path: str | list[str], registry: str) -> DataFrame:
    schema = "name string, version struct<_ver:string,_rel:string>, summary string, description string, url string, format struct<license:string>"
    # the XML source doesn't split files; ends of records as line ends do
    said = spark.read.option("lineSep", "</package>").text(path).select(F.regexp_extract("value", r"(?s)(<package\b.*)", 1).alias("value")).where("value <> ''")
    rows = said.select(F.from_xml(F.concat("value", F.lit("</package>")), schema, {"ignoreNamespace": "true"}).alias("x")).select("x.*")
    version = F.concat_ws("-", "version._ver", "version._rel")
    none = F.lit(None).cast("string")
    out = rows.select(F.lit(registry).alias("registry"), "name", F.nullif(version, F.lit("")).alias("version"), F.coalesce("summary", "description").alias("description"), F.col("url").alias("homepage"), none.alias("repository"), F.col("format.license").alias("license"), none.cast("long").alias("downloads"))
    return out.where("name is not null and version is not null")


def read(responses: DataFrame, registry: str) -> DataFrame:
    """Packages of one registry's responses (value); entries without a name or version are left out."""
    if registry in JSON_PATHS:
        columns = [_json(p) for p in JSON_PATHS[registry]]
        rows = responses.select(F.explode(F.coalesce(F.from_json("value", "array<string>"), F.array("value"))).alias("value")) if "value" in responses.columns else responses
    elif registry in STANZA_KEYS:
        form = "percent" if "NAME" in STANZA_KEYS[registry] else "colon"
        rows = responses.select(F.explode(F.split("value", r"\n\s*\n(?=%NAME%|%FILENAME%|\w)" if form == "colon" else r"\n\n(?=%NAME%|%FILENAME%)")).alias("value"))
        columns = [_stanza(k, form) for k in STANZA_KEYS[registry]]
    else:
        raise ValueError(f"unknown registry {registry}")
    out = rows.select(F.lit(registry).alias("registry"), *[c.alias(n) for c, n in zip(columns, FIELDS)])
    return out.withColumn("downloads", F.col("downloads").try_cast("long")).where("name is not null and version is not null")


def fresh_or_stale(cache: DataFrame, fetched: DataFrame, now: int, ttl: int = 86_400) -> DataFrame:
    """One row a package: the cached one within its time, else the fetched one, else the stale one.

    cache (name, fetched_at, value), fetched (name, value).
    """
    both = cache.join(fetched.select("name", F.col("value").alias("_new")), "name", "full")
    is_fresh = F.coalesce(F.col("fetched_at") > now - ttl, F.lit(False))
    take_new = ~is_fresh & F.col("_new").isNotNull()
    return both.select("name", F.when(take_new, F.lit(now)).otherwise(F.col("fetched_at")).alias("fetched_at"), F.when(take_new, F.col("_new")).otherwise(F.col("value")).alias("value"))
