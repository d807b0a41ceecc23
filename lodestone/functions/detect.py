"""Kind and schema version of artifact documents, from the URL in their metadata."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Artifact kinds and their newest schema version; all versions from 1 on are supported.
LATEST = {"manifest": 12, "catalog": 1, "run-results": 6, "sources": 3}
MALFORMED = "Malformed JSON"


def metadata(body: Column) -> Column:
    """Struct (metadata variant, malformed string) of a JSON text."""
    return F.from_json(body, "metadata variant, malformed string", {"columnNameOfCorruptRecord": "malformed"})


def facts(body: Column) -> Column:
    """Struct of a JSON text, which is parsed once however often its fields are used: url and bad.

    url: the text of metadata.dbt_schema_version; null if that is absent, empty or no string. bad: whether the text is no
    JSON; a JSON value that is no object, such as null, is JSON without metadata.
    """

    def told(m: Column) -> Column:
        value, text = (F.try_variant_get(m["metadata"], "$.dbt_schema_version", kind) for kind in ("variant", "string"))
        url = F.when((F.schema_of_variant(value) == "STRING") & (text != ""), text)
        return F.struct(url.alias("url"), (body.isNotNull() & m["malformed"].isNotNull() & F.try_parse_json(body).isNull()).alias("bad"))

    return let(metadata(body), told)


def schema_url(body: Column) -> Column:
    return facts(body)["url"]


def malformed(body: Column) -> Column:
    return facts(body)["bad"]


def _digits(kind: str, url: Column) -> Column:
    """The version number at the end of the URL as text without leading zeros; null if there is none."""
    found = F.nullif(F.regexp_extract(url, rf"/{kind}/v(\d+)\.json\z", 1), F.lit(""))
    return F.regexp_replace(found, r"^0+(?=\d)", "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often use refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def judged(kind: str, url: Column) -> Column:
    """Struct (error, version): what the automatic parser of a kind says about a URL; error is null if it accepts it."""
    bad = F.lit(f"Not a {kind}.json")

    def told(digits: Column) -> Column:
        known = F.coalesce(digits.try_cast("decimal(38,0)").between(1, LATEST[kind]), F.lit(False))
        error = F.when(digits.isNull(), bad).when(~known, F.concat(F.lit(f"Unsupported {kind} version: "), digits))
        error = error.when(~F.contains(url, F.concat(F.lit(f"/{kind}/v"), digits, F.lit(".json"))), F.concat(bad, F.lit(" v"), digits))
        return F.struct(error.alias("error"), F.when(error.isNull(), digits.try_cast("int")).alias("version"))

    named = F.coalesce(F.contains(url, F.lit(f"/{kind}/v")), F.lit(False))
    return F.when(named, let(_digits(kind, url), told)).otherwise(F.struct(bad.alias("error"), F.lit(None).cast("int").alias("version")))


def auto_error(kind: str, url: Column) -> Column:
    """What the automatic parser of a kind says about a URL; null if it accepts the document."""
    return judged(kind, url)["error"]


def pinned_error(kind: str, version: int, url: Column) -> Column:
    """What the parser of one version says: the URL must hold /kind/vN.json anywhere."""
    ok = F.coalesce(F.contains(url, F.lit(f"/{kind}/v{version}.json")), F.lit(False))
    return F.when(~ok, F.lit(f"Not a {kind}.json v{version}"))


def _fresh(df: DataFrame) -> str:
    name = "_facts"
    while name in df.columns:
        name += "_"
    return name


def outcomes(df: DataFrame, body: str = "body") -> DataFrame:
    """df with a row for each parser, automatic and pinned, of each kind: parser and error. A document is parsed once."""
    name = _fresh(df)
    out = df.withColumn(name, facts(F.col(body)))
    url = F.col(name)["url"]
    said = [(f"{kind} auto", auto_error(kind, url)) for kind in LATEST] + [(f"{kind} v{v}", pinned_error(kind, v, url)) for kind, top in LATEST.items() for v in range(1, top + 1)]
    each = [F.struct(F.lit(p).alias("parser"), F.when(F.col(name)["bad"], F.lit(MALFORMED)).otherwise(e).alias("error")) for p, e in said]
    return out.select(*df.columns, F.inline(F.array(*each)))


def read(df: DataFrame, body: str = "body", name: str = "facts") -> DataFrame:
    """df with the facts of each document as a column, which parsers may be given, so that many of them share one reading."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != name], F.inline(F.array(F.struct(facts(F.col(body)).alias(name)))))


def _parsed(df: DataFrame, body: str, judge: Callable[[Column], Column], strict: bool, known: str | None) -> DataFrame:
    """df with what judge says of each document's URL. The generator keeps filters on it from parsing documents again."""

    def told(f: Column) -> Column:
        said = F.when(f["bad"], F.struct(F.lit(MALFORMED).alias("error"), F.lit(None).cast("int").alias("version"))).otherwise(judge(f["url"]))
        return let(said, lambda s: F.struct(f["url"].alias("schema_url"), s["error"].alias("error"), s["version"].alias("version")))

    others = [F.col(f"`{c}`") for c in df.columns if c not in ("schema_url", "error", "version")]
    out = df.select(*others, F.inline(F.array(let(F.col(known) if known else facts(F.col(body)), told))))
    if strict:
        out = out.withColumn(body, F.when(F.col("error").isNull(), F.col(body)).otherwise(F.raise_error(F.col("error")).cast("string")))
    return out


def parse(df: DataFrame, kind: str, body: str = "body", strict: bool = False, known: str | None = None) -> DataFrame:
    """df with schema_url, error and version: the automatic parser of a kind.

    The document itself stays as it is. strict raises the error when the body is read; else the error is a column. known names
    a column that `read` has made, which is then used in place of the body.
    """
    return _parsed(df, body, lambda url: judged(kind, url), strict, known)


def parse_version(df: DataFrame, kind: str, version: int, body: str = "body", strict: bool = False, known: str | None = None) -> DataFrame:
    """df as the parser of one version sees it."""

    def judge(url: Column) -> Column:
        return let(pinned_error(kind, version, url), lambda e: F.struct(e.alias("error"), F.when(e.isNull(), F.lit(version)).alias("version")))

    return _parsed(df, body, judge, strict, known)


def detect(df: DataFrame, body: str = "body") -> DataFrame:
    """df with kind, version, schema_url and error: the first kind whose automatic parser accepts each document.

    If none does, the kind is the first that the URL names and the error is that kind's; null without such a kind.
    """

    def cell(kind: Column, version: Column, error: Column) -> Column:
        return F.struct(kind.cast("string").alias("kind"), version.cast("int").alias("version"), error.alias("error"))

    def told(f: Column) -> Column:
        url = f["url"]
        named = {k: F.contains(url, F.lit(f"/{k}/v")) for k in LATEST}
        accepted = lambda k: lambda j: F.when(j["error"].isNull(), cell(F.lit(k), j["version"], j["error"]))
        taken = [F.when(named[k], let(judged(k, url), accepted(k))) for k in LATEST]
        refused = [F.when(named[k], cell(F.lit(k), F.lit(None), auto_error(k, url))) for k in LATEST]
        first = F.coalesce(*taken, *refused, cell(F.lit(None), F.lit(None), F.lit("Not an artifact")))
        return let(first, lambda c: F.struct(url.alias("schema_url"), c["kind"].alias("kind"), c["version"].alias("version"), F.when(f["bad"], F.lit(MALFORMED)).otherwise(c["error"]).alias("error")))

    others = [F.col(f"`{c}`") for c in df.columns if c not in ("schema_url", "kind", "version", "error")]
    return df.select(*others, F.inline(F.array(let(facts(F.col(body)), told))))
