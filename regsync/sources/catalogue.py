"""The public course catalogue as a Spark data source."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from urllib.error import HTTPError
from urllib.parse import quote
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Identifiers of the catalogue, paths under its address, and the number of courses where it doesn't say.
FIRST_ID, LAST_ID, DEFAULT_COURSES = 1, 260, 215
HOME, VERSION = "/cnct-api/home/", "/cnct-api/version"
HEADERS = {"User-Agent": "Mozilla/5.0", "Accept": "application/json, text/plain, */*"}


def get_json(url: str, timeout: float = 10, attempts: int = 2, open_: Callable = urlopen, sleep: Callable = time.sleep):
    """(status, parsed body): 404 ends at once, other failures wait longer each time, the last gives (0, None)."""
    for attempt in range(attempts):
        try:
            with open_(Request(url, headers=HEADERS), timeout=timeout) as answer:
                return answer.status, json.loads(answer.read().decode("utf-8"))
        except HTTPError as e:
            if e.code == 404:
                return 404, None
        except Exception:  # noqa: BLE001  network and format errors count as a failed attempt
            pass
        if attempt + 1 < attempts:
            sleep(0.5 * (attempt + 1))
    return 0, None


def is_course(status: int, body) -> bool:
    """Whether an answer is a course: a record that has a name or an id."""
    return status == 200 and isinstance(body, dict) and ("nome" in body or "id" in body)


def first_course(shapes: list[str], fetch: Callable) -> dict | None:
    """The first of several URL shapes that gives a course."""
    for url in shapes:
        status, body = fetch(url)
        if is_course(status, body):
            return body
    return None


def ping(base: str, fetch: Callable = get_json) -> tuple[bool, object]:
    """(whether the catalogue answers, the version that it names); never fails."""
    status, body = fetch(f"{base}{VERSION}", timeout=10)
    return status == 200, body


def home(base: str, fetch: Callable = get_json) -> dict | None:
    """The catalogue's front record, or None."""
    status, body = fetch(f"{base}{HOME}")
    return body if status == 200 and isinstance(body, dict) else None


def institutions_url(base: str, course: str) -> str:
    return f"{base}{quote(course)}"


def total_courses(home: dict | None) -> int:
    """The catalogue's own count, or the default."""
    try:
        return int(home["catalogo"]["quantidadeCursos"]) or DEFAULT_COURSES
    except (TypeError, KeyError, ValueError):
        return DEFAULT_COURSES


class CatalogueSource(DataSource):
    """format("catalogue"): rows (key, status, body) for URLs made of the option ``urls``, patterns with {key} parted by spaces.

    Options: first, last (ids) or keys (parted by newlines), partitions, delay (seconds between requests of a
    partition), timeout, accept (``any`` body that isn't empty, or only a ``course`` or a ``list``).  A pattern that starts
    with file: reads a local capture, for tests.
    """

    @classmethod
    def name(cls):
        return "catalogue"

    def schema(self):
        return "key string, status int, body string"

    def reader(self, schema):
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def _keys(self) -> list[str]:
        if "keys" in self.options:
            return [k for k in self.options["keys"].split("\n") if k]
        return [str(i) for i in range(int(self.options.get("first", FIRST_ID)), int(self.options.get("last", LAST_ID)) + 1)]

    def partitions(self):
        keys, n = self._keys(), max(1, int(self.options.get("partitions", 8)))
        size = -(-len(keys) // n) or 1
        return [InputPartition(keys[i : i + size]) for i in range(0, len(keys), size)]

    def read(self, partition):
        delay, timeout = float(self.options.get("delay", 0.5)), float(self.options.get("timeout", 8))
        fits = {"any": lambda status, body: bool(body), "course": is_course, "list": lambda status, body: status == 200 and isinstance(body, list)}[self.options.get("accept", "any")]

        def fetch(url):
            if url.startswith("file:"):
                try:
                    with open(url[5:], encoding="utf-8") as f:
                        return 200, json.load(f)
                except OSError:
                    return 404, None
            return get_json(url, timeout)

        for i, key in enumerate(partition.value):
            shapes = [u.replace("{key}", quote(key)) for u in self.options["urls"].split(" ")]
            if i and not shapes[0].startswith("file:"):
                time.sleep(delay)
            status, body = 0, None
            for url in shapes:
                status, body = fetch(url)
                if fits(status, body):
                    break
                body = None
            yield key, status, json.dumps(body, ensure_ascii=False) if body is not None else None


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CatalogueSource)


def fetch(spark: SparkSession, urls: list[str], record: str, **options) -> DataFrame:
    """Records of the given DDL schema, with their key; lists give a row for each entry."""
    register(spark)
    raw = spark.read.format("catalogue").options(urls=" ".join(urls), **{k: str(v) for k, v in options.items()}).load()
    one = F.from_json("body", record)
    many = F.from_json("body", f"array<struct<{_nested(record)}>>")
    rows = F.when(F.ltrim("body").startswith("["), many).otherwise(F.array(one))
    return raw.where("body is not null").select("key", F.explode(rows).alias("r")).select("key", "r.*")


def _nested(ddl: str) -> str:
    out, depth = [], 0
    for part in ddl.split(", "):
        out.append(part.replace(" ", ": ", 1) if depth == 0 else part)
        depth += part.count("<") - part.count(">")
    return ", ".join(out)
