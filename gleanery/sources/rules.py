"""Rule files: one YAML document per source, read as tables."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from gleanery.session import written

RULES = "path string, size bigint, modified timestamp, id string, document string, error string"

_FIELD = "attribute string, `default` string, optional boolean, remove string, selector string, text string"
# The parts of a document the tables are made of.
DOCUMENT = f"""
id string, name string, description string, language string, type string, encoding string,
links array<string>, legacylinks array<string>, replaces array<string>, request_delay double, login boolean,
settings array<struct<name:string,type:string,`default`:string>>,
caps struct<allow_raw_search:boolean,allow_tv_imdb:boolean,modes:map<string,array<string>>,
  mappings:array<struct<id:string,cat:string,desc:string,is_default:boolean>>>,
search struct<
  paths:array<struct<path:string,method:string,categories:array<string>,inherit:boolean,response:string,no_results:string,inputs:map<string,string>>>,
  inputs:map<string,string>, allow_empty:boolean,
  rows:struct<selector:string,after:int,remove:string,attribute:string,multiple:boolean,missing_is_empty:boolean>,
  fields:array<struct<name:string,modifiers:array<string>,optional:boolean,selector:string,attribute:string,text:string,remove:string,`default`:string,
    arms:array<struct<selector:string,value:string>>,filters:array<struct<name:string,args:array<string>>>>>>
"""


def _flag(value, unset=False) -> bool:
    return str(value).strip().lower() in ("true", "yes", "on", "y", "1", "t") if value not in (None, "") else unset


def _text(value) -> str:
    return "" if value is None or value in ("null", "~") else str(value)


def _list(value) -> list:
    if value in (None, "", "null", "~"):
        return []
    return [_text(v) for v in value] if isinstance(value, list) else [_text(value)]


def _filters(value) -> list[dict]:
    return [{"name": _text(f.get("name")), "args": _list(f["args"]) if "args" in f else []} for f in value or []]


def _field(raw: dict, key: str = "") -> dict:
    name, *modifiers = key.split("|")
    optional_names = (
        "description doubanid genre imdb imdbid poster rageid tmdbid traktid tvdbid tvmazeid".split()  # fixed value
    )
    raw = raw if isinstance(raw, dict) else {}
    return {
        "name": name,
        "modifiers": modifiers,
        "optional": _flag(raw.get("optional")) or "optional" in modifiers or (not modifiers and name in optional_names),
        **{k: _text(raw.get(k)) for k in ("selector", "attribute", "text", "remove", "default")},
        "arms": [{"selector": _text(k), "value": _text(v)} for k, v in (raw.get("case") or {}).items()],
        "filters": _filters(raw.get("filters")),
    }


def _inputs(value) -> dict:
    return {k: _text(v) for k, v in (value or {}).items()}


def _path(raw: dict) -> dict:
    response = raw.get("response") or {}
    kind = _text(response.get("type")).lower()
    return {
        "path": _text(raw.get("path")),
        "method": "post" if _text(raw.get("method")).lower() == "post" else "get",
        "categories": _list(raw.get("categories")),
        "inherit": _flag(raw.get("inheritinputs"), True),
        "response": kind if kind in ("json", "xml") else "html",
        "no_results": _text(response.get("noResultsMessage")),
        "inputs": _inputs(raw.get("inputs")),
    }


def read_document(text: str) -> dict:
    """One YAML document in the shape of DOCUMENT; scalars keep their written text.

    Two older spellings are folded in: a caps.categories map comes before the mapping
    list, and a single search.path comes after the paths.
    """
    import yaml

    raw = yaml.load(text, Loader=yaml.BaseLoader)
    if not isinstance(raw, dict):
        raise ValueError("a rule file must be a mapping")
    caps, search = raw.get("caps") or {}, raw.get("search") or {}
    rows, old = search.get("rows") or {}, caps.get("categories")
    if old and not isinstance(old, dict):
        raise ValueError("caps.categories must be a mapping")
    if not isinstance(search.get("fields") or {}, dict):
        raise ValueError("fields: expected a mapping")
    mappings = [{"id": _text(k), "cat": _text(v), "desc": "", "is_default": False} for k, v in (old or {}).items()]
    for m in caps.get("categorymappings") or []:
        if isinstance(m.get("id"), (list, dict)):
            raise ValueError("categorymappings id: expected a scalar")
        mappings.append(
            {"id": _text(m.get("id")), "cat": _text(m.get("cat")), "desc": _text(m.get("desc")), "is_default": _flag(m.get("default"))}
        )
    paths = [_path(p) for p in search.get("paths") or []]
    if _text(search.get("path")):
        paths.append(_path({"path": search["path"]}))
    headers, count = rows.get("dateheaders"), rows.get("count")
    return {
        "id": _text(raw.get("id")) or _text(raw.get("name")),
        **{k: _text(raw.get(k)) for k in ("name", "description", "language", "type", "encoding")},
        **{k: _list(raw.get(k)) for k in ("links", "legacylinks", "replaces")},
        "request_delay": float(_text(raw.get("requestDelay")) or 0),
        "login": bool(raw.get("login")),
        "settings": [
            {"name": _text(s.get("name")), "type": _text(s.get("type")), "default": s.get("default")} for s in raw.get("settings") or []
        ],
        "caps": {
            "allow_raw_search": _flag(caps.get("allowrawsearch")),
            "allow_tv_imdb": _flag(caps.get("allowtvsearchimdb")),
            "modes": {k: _list(v) for k, v in (caps.get("modes") or {}).items()},
            "mappings": mappings,
        },
        "search": {
            "paths": paths,
            "inputs": _inputs(search.get("inputs")),
            "allow_empty": _flag(search.get("allowEmptyInputs")),
            "keywordsfilters": _filters(search.get("keywordsfilters")),
            "preprocessingfilters": _filters(search.get("preprocessingfilters")),
            "error": [
                {"selector": _text(e.get("selector")), "message": _field(e.get("message") or {})} for e in search.get("error") or []
            ],
            "rows": {
                "selector": _text(rows.get("selector")),
                "after": int(_text(rows.get("after")) or 0),
                "remove": _text(rows.get("remove")),
                "attribute": _text(rows.get("attribute")),
                "multiple": _flag(rows.get("multiple")),
                "missing_is_empty": _flag(rows.get("missingAttributeEqualsNoResults")),
                "count": _field(count) if count else None,
                "dateheaders": _field(headers) if headers else None,
                "filters": _filters(rows.get("filters")),
            },
            "fields": [_field(v, k) for k, v in (search.get("fields") or {}).items()],
        },
    }


def _files(spark: SparkSession, path: str) -> DataFrame | None:
    """YAML files directly in a folder, as (path, modificationTime, length, content); None when there is no folder."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    return (
        spark.read.format("binaryFile")
        .load(path)
        .filter(F.lower("path").rlike(r"\.ya?ml$"))
    )


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, modified, id, document JSON, error): a broken file has an error and hides no other."""
    files = _files(spark, path)
    return spark.createDataFrame([], RULES) if files is None else parse_rules(files)


def parse_rules(files: DataFrame) -> DataFrame:
    """read_rules over files already at hand as (path, length, modificationTime, content)."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                try:
                    doc = read_document(bytes(row.content).decode("utf-8"))
                    out.append((row.path, row.length, row.modificationTime, doc["id"], json.dumps(doc), None))
                except Exception as problem:
                    out.append((row.path, row.length, row.modificationTime, None, None, str(problem)))
            yield pd.DataFrame(out, columns=["path", "size", "modified", "id", "document", "error"])

    # A file of many documents is one small split, yet reading a document costs far more than moving it.
    return files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))).mapInPandas(parse, RULES)


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    """(source, name, value) from one settings map per source, the file name being the source id."""
    schema = "source string, name string, value string"
    files = _files(spark, path)
    if files is None:
        return spark.createDataFrame([], schema)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                source = row.path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                values = yaml.load(bytes(row.content).decode("utf-8"), Loader=yaml.BaseLoader)
                out += [(source, k, _text(v)) for k, v in (values or {}).items()] if isinstance(values, dict) else []
            yield pd.DataFrame(out, columns=["source", "name", "value"])

    return files.mapInPandas(parse, schema)


def reject_duplicate_ids(rules: DataFrame, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(usable rules, errors): an id two files share makes both unusable. The rules are parsed once and
    kept for both, in a folder the caller names and removes, or one of their own."""
    rules = written(rules, "rules", path)
    parsed = rules.filter(F.col("id").isNotNull())
    clashing = parsed.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id")
    message = F.concat(F.lit('duplicate tracker id "'), F.col("id"), F.lit('"'))
    duplicates = parsed.join(clashing, "id", "left_semi").select("path", message.alias("error"))
    broken = rules.filter(F.col("error").isNotNull()).select("path", "error")
    return parsed.join(clashing, "id", "left_anti").select(*rules.columns), broken.unionByName(duplicates)


def last_good(versions: DataFrame) -> DataFrame:
    """Latest version of each file, serving the last parse that worked while reporting the new error.

    versions: path, version, id, document, error. A file that never parsed is left out.
    """
    good = F.col("document").isNotNull()
    newest = F.struct("version", "error")
    return (
        versions.groupBy("path")
        .agg(
            F.max(newest).alias("n"),
            F.max(F.when(good, F.struct("version", "id", "document"))).alias("g"),
        )
        .filter(F.col("g").isNotNull())
        .select("path", F.col("n.version").alias("version"), F.col("g.id").alias("id"), F.col("g.document").alias("document"), F.col("n.error").alias("error"))
    )


def changed_files(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(path, change): new, changed (size or time differs) or gone; unchanged files are not parsed again."""
    p, c = previous.alias("p"), current.alias("c")
    joined = p.join(c, F.col("p.path") == F.col("c.path"), "full_outer")
    same = (F.col("p.size") == F.col("c.size")) & (F.col("p.modified") == F.col("c.modified"))
    change = (
        F.when(F.col("c.path").isNull(), F.lit("gone"))
        .when(F.col("p.path").isNull(), F.lit("new"))
        .when(~same, F.lit("changed"))
    )
    return joined.select(F.coalesce("c.path", "p.path").alias("path"), change.alias("change")).filter("change IS NOT NULL")


# --- typed tables --------------------------------------------------------------------


def _typed(rules: DataFrame) -> DataFrame:
    return rules.filter("document IS NOT NULL").select(
        F.element_at(F.split("path", "/"), -1).alias("file_name"), F.from_json("document", DOCUMENT).alias("d")
    )


def sources_table(rules: DataFrame) -> DataFrame:
    """One row per source, in the layout routing.SOURCES."""
    d = _typed(rules)
    templates = F.concat(
        F.map_values(F.coalesce("d.search.inputs", F.create_map().cast("map<string,string>"))),
        F.transform("d.search.paths", lambda p: p["path"]),
        F.flatten(F.transform("d.search.paths", lambda p: F.map_values(p["inputs"]))),
    )
    paged = F.exists(templates, lambda t: t.rlike(r"\.Query\.(Offset|Limit)"))
    return d.select(
        "d.id", "d.name", "d.description", "d.language", "d.type", "d.links",
        F.col("d.legacylinks").alias("legacy_links"), "d.replaces", "d.encoding", "d.request_delay",
        "d.caps.allow_raw_search", "d.caps.allow_tv_imdb", "d.caps.modes", F.col("d.login").alias("requires_login"),
        F.coalesce(paged, F.lit(False)).alias("pages_server_side"), "file_name",
    )


def mappings_table(rules: DataFrame) -> DataFrame:
    return (
        _typed(rules)
        .select(F.col("d.id").alias("source"), F.posexplode("d.caps.mappings").alias("ordinal", "m"))
        .select("source", "ordinal", F.col("m.id").alias("cat_id"), "m.cat", "m.desc", "m.is_default")
    )


def settings_table(rules: DataFrame) -> DataFrame:
    return (
        _typed(rules)
        .select(F.col("d.id").alias("source"), F.explode("d.settings").alias("s"))
        .select("source", "s.name", "s.type", F.col("s.default").alias("default"))
    )


def paths_table(rules: DataFrame) -> DataFrame:
    return (
        _typed(rules)
        .select(F.col("d.id").alias("source"), F.posexplode("d.search.paths").alias("path_ordinal", "p"))
        .select("source", "path_ordinal", "p.path", "p.method", "p.categories", "p.inherit", "p.response")
    )


def fields_table(rules: DataFrame) -> DataFrame:
    return (
        _typed(rules)
        .select(F.col("d.id").alias("source"), F.posexplode("d.search.fields").alias("ordinal", "f"))
        .select("source", "ordinal", "f.*")
    )


def definitions(rules: DataFrame) -> list[dict]:
    """The documents as dicts, for compiling plans. Rule files are configuration: one small row per source."""
    rows = rules.filter("document IS NOT NULL").select("path", "document").orderBy("path").collect()
    return [json.loads(r.document) for r in rows]
