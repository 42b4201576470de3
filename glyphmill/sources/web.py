"""Search services and crawls as DataFrame steps: requests are rows, answers are parsed as JSON columns.

Each request is tried several times with growing pauses. One that fails for good is logged and gives no rows, so a
service that is down never stops a job, or the other services (see overlap.failover).
"""

from __future__ import annotations

import json
import logging
import os
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators import corpus as C
from ..session import ship, stored
from . import files

Get = Callable[[str], bytes]
SOURCES = "url string, title string, kind string, text string, ord bigint"
# The services' addresses, what is asked of them, and how they answer.
OPENALEX = "https://api.openalex.org/works"
WIKIPEDIA = "https://{lang}.wikipedia.org/w/api.php"
SEARCH_WORKS = {"per-page": 5, "filter": "has_abstract:true", "select": "id,doi,title,abstract_inverted_index"}
SAMPLE_WORKS = {"filter": "language:es,has_abstract:true,publication_year:2010-2021,type:article", "sample": 200, "per_page": 200, "select": "id,title,publication_year,abstract_inverted_index,primary_topic"}
SEARCH_PAGES = {"action": "query", "list": "search", "srlimit": 3, "format": "json"}
EXTRACT = {"action": "query", "prop": "extracts", "explaintext": 1, "format": "json", "formatversion": 2}
RANDOM_PAGES = {"action": "query", "generator": "random", "grnnamespace": 0, "grnlimit": 50, "prop": "info", "format": "json"}
REVISION = {"action": "query", "prop": "revisions", "rvlimit": 1, "rvdir": "older", "rvprop": "ids|timestamp", "format": "json"}
PARSED = {"action": "parse", "prop": "text", "format": "json", "formatversion": 2}
WORKS = "results array<struct<id:string,doi:string,title:string,publication_year:int,abstract_inverted_index:map<string,array<int>>,primary_topic:struct<field:struct<display_name:string>>>>"
HITS = "query struct<search:array<struct<title:string>>>"
EXTRACTS = "query struct<pages:array<struct<extract:string>>>"
PAGES = "query struct<pages:map<string,struct<title:string,length:bigint>>>"
REVISIONS = "query struct<pages:map<string,struct<revisions:array<struct<revid:bigint,timestamp:string>>>>>"
PARSES = "parse struct<text:string>"
LEAST_PAGE, CUTOFF = 12_000, "2021-12-31T23:59:59Z"


#: Answers after which a request is worth repeating; all others are final.
RETRIED = frozenset((408, 425, 429, 500, 502, 503, 504))


def urlopen(url: str) -> bytes:
    agent = os.environ.get("GLYPHMILL_USER_AGENT", "glyphmill (set GLYPHMILL_USER_AGENT to how you can be reached)")  # services refuse requests without one
    with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": agent}), timeout=10) as answer:
        return answer.read()


def _asked_to_wait(e: Exception) -> float | None:
    """Seconds that a refusal names, if it names any."""
    named = (getattr(e, "headers", None) or {}).get("Retry-After", "")
    return float(named) if named.strip().isdigit() else None


def fetch_json(url: str, params: Mapping, tries: int = 5, get: Get | None = None, pause: Callable[[float], None] = time.sleep, most: float = 60.0):
    """A JSON answer, or null if there is none after `tries` attempts or the service says that it is final.

    Between attempts it waits as long as the service asks for, else twice as long each time; `most` seconds at most.
    """
    request, wait = f"{url}?{urllib.parse.urlencode(params)}", 1.0
    for left in range(tries - 1, -1, -1):
        named = None
        try:
            return json.loads((get or urlopen)(request))
        except urllib.error.HTTPError as e:
            if e.code not in RETRIED:
                return None
            named = _asked_to_wait(e)
        except (OSError, ValueError):
            pass  # no connection, or half an answer
        if left:
            pause(min(most, wait if named is None else named))
            wait *= 2
    return None


def answers(asked: DataFrame, endpoint: str, params: Mapping, by: Mapping[str, str], get: Get | None = None, tries: int = 5) -> DataFrame:
    """asked with `answer`, JSON as text, null after repeated failure. by: which parameter each column of asked fills.

    Requests go out from the tasks, one after the other in each; how many partitions asked has bounds how many at once.
    """
    ship(asked.sparkSession)
    columns = asked.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for row in frame.to_dict("records"):
                own = dict(params) | {name: row[c] for name, c in by.items()}
                try:
                    got = fetch_json(endpoint, own, tries, get)
                except Exception as e:  # whatever a service does must not stop the job
                    logging.getLogger(__name__).warning("%s %s: %s", endpoint, own, e)
                    got = None
                found.append(None if got is None else json.dumps(got, ensure_ascii=False))
            yield frame[columns].assign(answer=found)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema.fields)
    return asked.mapInPandas(run, f"{kinds}, answer string")


def read(schema: str) -> Column:
    """The answer as a struct; null fields where it has another form."""
    return F.from_json("answer", schema)


def openalex_search(get: Get | None = None):
    """A search of works: from (query) to sources, by their abstracts."""

    def search(asked: DataFrame) -> DataFrame:
        found = T.exploded(answers(asked, OPENALEX, SEARCH_WORKS, {"search": "query"}, get), [], read(WORKS)["results"], "w").select("w.*")
        return files.indexed_works(found.where(F.size("abstract_inverted_index") > 0))

    return search


def wikipedia_search(lang: str = "es", get: Get | None = None):
    """A search of articles: from (query) to sources, by their plain texts."""

    def search(asked: DataFrame) -> DataFrame:
        api = WIKIPEDIA.format(lang=lang)
        titles = T.exploded(answers(asked, api, SEARCH_PAGES, {"srsearch": "query"}, get), [], read(HITS)["query"]["search"], "hit").select("hit.title").distinct()
        texts = answers(titles, api, EXTRACT, {"titles": "title"}, get).select("title", F.get(read(EXTRACTS)["query"]["pages"], F.lit(0))["extract"].alias("text"))
        url = T.wiki_url(F.col("title"), lang)
        return texts.where(F.length("text") > 0).select(url.alias("url"), "title", F.lit("Wikipedia").alias("kind"), "text", F.xxhash64(url).alias("ord"))

    return search


def work_items(answered: DataFrame) -> DataFrame:
    """(id, text, title, field, year, source) of the works in answers to a sample request."""
    w = T.exploded(answered, [], read(WORKS)["results"], "w").select("w.*")
    text = T.clean_abstract(T.unindex(F.col("abstract_inverted_index")))
    rows = w.where((F.size("abstract_inverted_index") > 0) & (F.length("title") > 0))
    field = F.coalesce(F.col("primary_topic.field.display_name"), F.lit("desconocido"))
    return rows.select(F.concat(F.lit("oa_"), F.substring_index("id", "/", -1)).alias("id"), text.alias("text"), T.strip(F.regexp_replace("title", "<[^>]+>", "")).alias("title"), field.alias("field"), F.col("publication_year").alias("year"), F.col("id").alias("source"))


def openalex_items(spark: SparkSession, seeds: int = 200, get: Get | None = None) -> DataFrame:
    """work_items of sampled works, one sample a seed; see corpus.human_items for what may stay, requests.crawl for one that stops in time."""
    asked = spark.range(1, seeds + 1).select(F.col("id").alias("seed")).repartition(min(seeds, 16))
    return work_items(answers(asked, OPENALEX, SAMPLE_WORKS, {"seed": "seed"}, get))


def article_items(answered: DataFrame, lang: str = "es", get: Get | None = None) -> DataFrame:
    """(id, text, title, field, year, source) of the long articles in answers to a random request, as they stood at CUTOFF, up to about 600 words of each."""
    api = WIKIPEDIA.format(lang=lang)
    pages = T.exploded(answered, [], F.map_values(read(PAGES)["query"]["pages"]), "p").select("p.title", "p.length").where(F.col("length") >= LEAST_PAGE)
    pages = pages.select("title").distinct()
    revision = F.get(F.get(F.map_values(read(REVISIONS)["query"]["pages"]), F.lit(0))["revisions"], F.lit(0))
    dated = answers(pages, api, REVISION | {"rvstart": CUTOFF}, {"titles": "title"}, get).select("title", revision.alias("r")).where("r.revid is not null").select("title", F.col("r.revid").alias("revid"), F.substring("r.timestamp", 1, 4).cast("int").alias("year"))
    parsed = answers(dated, api, PARSED, {"oldid": "revid"}, get).select("revid", "title", "year", read(PARSES)["parse"]["text"].alias("html")).where("html is not null")
    parsed = stored(parsed)  # read twice below, asked for once
    parts = T.exploded(files.html_paragraphs(parsed, "revid"), ["revid"], F.col("paragraphs"), "text", "k")
    texts = C.article_text(parts, "revid")
    source = F.concat(F.lit(f"https://{lang}.wikipedia.org/w/index.php?oldid="), "revid")
    return texts.join(parsed.select("revid", "title", "year"), "revid").select(F.concat(F.lit("wk_"), "revid").alias("id"), "text", "title", F.lit("wikipedia").alias("field"), "year", source.alias("source"))


def wikipedia_items(spark: SparkSession, batches: int, lang: str = "es", get: Get | None = None) -> DataFrame:
    """article_items of `batches` random requests."""
    asked = spark.range(batches).select(F.col("id").alias("batch")).repartition(min(batches, 16))
    return article_items(answers(asked, WIKIPEDIA.format(lang=lang), RANDOM_PAGES, {}, get), lang, get)
