"""URL filter over a sorted digest array (operator 10).

Entries are strings `host + path prefix` (like `example.net/en/`).  Their 64-bit xxhash keys stand sorted
in one file, with the strings behind them, that Spark brings to every executor and each Python worker maps into memory once; a url's candidate entries (every suffix of its host
by labels, with every prefix of its path that has the length of some entry's path) are hashed, probed
by one vectorised binary search a batch, and each hit is confirmed against the stored full string, so a
collision of keys never decides.

Two arrays share the code: allow/block rules, of which the longest that fits wins, and a block list of hosts for
urls without a rule.  It is a sequence or a table (`read_hosts` reads one from a file) and goes to every executor, so its size is checked
against `most_bytes`: a larger sequence raises, of a larger table `judge_joined` makes the same rows by a join.

Rows: a null url or one without `://` has empty host and path, no rule, and verdict allow; repeated
rows each get a row; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import mmap
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, small_batches

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Hosts (with all subdomains and paths) that the method blocks where no rule fits.
BLOCK_HOSTS = tuple(f"{name}.example.{top}" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org"))
MOST_BYTES = 256 << 20
_TO_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): host after the first `://` up to `/`, `?`, `#`, A-Z lower-cased; path from there to `?` or `#`."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    rest = rest.partition("#")[0].partition("?")[0]
    host, slash, path = rest.partition("/")
    return host.translate(_TO_LOWER), slash + path


class DigestArray:
    """Sorted 64-bit keys of byte strings, with the strings and a tag each, all in one buffer:

        u64 entries | keys | u64 offset of each string and of the end | u32 tags | strings"""

    def __init__(self, entries: list[tuple[str, int]], hash_of=xxhash.xxh64_intdigest):
        self.hash_of = hash_of
        keyed = sorted((hash_of(s.encode()), s.encode(), tag) for s, tag in entries)
        ends = np.cumsum([0, *(len(s) for _, s, _ in keyed)]).astype("<u8")
        parts = (np.array([len(keyed)], "<u8"), np.array([k for k, _, _ in keyed], "<u8"), ends, np.array([t for _, _, t in keyed], "<u4"))
        self._read(b"".join([*(p.tobytes() for p in parts), *(s for _, s, _ in keyed)]))

    @classmethod
    def over(cls, buffer, hash_of=xxhash.xxh64_intdigest) -> DigestArray:
        """The array that a buffer (like a mapped file) holds."""
        out = cls.__new__(cls)
        out.hash_of = hash_of
        out._read(buffer)
        return out

    def _read(self, buffer) -> None:
        self.buffer, n = buffer, int(np.frombuffer(buffer, "<u8", 1)[0])
        self.keys = np.frombuffer(buffer, "<u8", n, 8)
        self.ends = np.frombuffer(buffer, "<u8", n + 1, 8 + 8 * n)
        self.tags = np.frombuffer(buffer, "<u4", n, 16 + 16 * n)
        self.first = 16 + 20 * n

    @property
    def nbytes(self) -> int:
        """Bytes of the entries; an empty array has none."""
        return len(self.buffer) - 16

    def mapped(self) -> DigestArray:
        """This array over a memory map of its own."""
        m = mmap.mmap(-1, len(self.buffer))
        m.write(self.buffer)
        return DigestArray.over(m, self.hash_of)

    def string(self, i: int) -> bytes:
        return self.buffer[self.first + int(self.ends[i]) : self.first + int(self.ends[i + 1])]

    def probe(self, strings: list[bytes]) -> list[int | None]:
        """The tag of each string, None where it isn't an entry."""
        out: list[int | None] = [None] * len(strings)
        if not strings or not len(self.keys):
            return out
        wanted = np.fromiter(map(self.hash_of, strings), np.uint64, len(strings))
        at = np.searchsorted(self.keys, wanted)
        hits = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == wanted)
        for i in hits.tolist():
            for j in range(int(at[i]), len(self.keys)):  # equal keys stand side by side
                if self.keys[j] != wanted[i]:
                    break
                if self.string(j) == strings[i]:
                    out[i] = int(self.tags[j])
                    break
        return out


def ship(spark: SparkSession, array: DigestArray) -> str:
    """Writes an array to the shared folder and has Spark bring the file to every executor; returns its name there."""
    name = f"digests-{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    for i in range(0, len(array.buffer), 8 << 20):
        out.write(bytearray(array.buffer[i : i + (8 << 20)]))
    out.close()
    spark.sparkContext.addFile(path)
    return name


_mapped: dict[str, DigestArray] = {}


def mapped_file(name: str) -> DigestArray:
    """The array of a shipped file, memory-mapped once a Python worker; all workers of a machine share its pages."""
    if name not in _mapped:
        while len(_mapped) > 3:
            _mapped.pop(next(iter(_mapped)))
        with open(SparkFiles.get(name), "rb") as f:
            _mapped[name] = DigestArray.over(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
    return _mapped[name]


def suffixes(host: str) -> list[str]:
    """The host and its parents, longest first."""
    labels = host.split(".")
    return [".".join(labels[i:]) for i in range(len(labels))]


def read_hosts(spark: SparkSession, path: str) -> DataFrame:
    """host: a Parquet table's column of that name, or a text file's lines without empty ones and what follows a #; A-Z lower-cased."""
    if path.rstrip("/").endswith(".parquet"):
        host = spark.read.parquet(path).select(F.col("host").cast("string"))
    else:
        host = spark.read.text(path).select(F.regexp_replace("value", r"#.*", F.lit("")).alias("host"))
    lower = F.translate(F.trim("host"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host.select(lower.alias("host")).where("host <> ''").distinct()


def judge(pages: DataFrame, rules=RULES, block_hosts=BLOCK_HOSTS, *, id_col: str = "page_id", url_col: str = "url", most_bytes: int = MOST_BYTES) -> DataFrame:
    """page_id, host, path, rule, verdict, listed (the block-list host that decided)."""
    spark = pages.sparkSession
    small_batches(spark)
    if isinstance(block_hosts, DataFrame):
        table = block_hosts.select(F.col("host").cast("string").alias("host")).where("host is not null").distinct()
        size = table.agg(F.sum(F.octet_length("host") + 16)).first()[0] or 0
        if size + DigestArray([(r, i) for i, (_, r) in enumerate(rules)]).nbytes > most_bytes:
            return judge_joined(pages, table, rules=rules, id_col=id_col, url_col=url_col, most_bytes=most_bytes)
        block_hosts = tuple(r["host"] for r in table.collect())
    rule_array = DigestArray([(r, i) for i, (_, r) in enumerate(rules)])
    host_array = DigestArray([(h, i) for i, h in enumerate(block_hosts)])
    if rule_array.nbytes + host_array.nbytes > most_bytes:
        raise ValueError(f"the lists have {rule_array.nbytes + host_array.nbytes} bytes, more than most_bytes; use judge_joined")
    lengths = sorted({len(r) - r.index("/") for _, r in rules}, reverse=True)
    rule_file, host_file = ship(spark, rule_array), ship(spark, host_array)

    def run(batches):
        by_rule, by_host = mapped_file(rule_file), mapped_file(host_file)
        for batch in batches:
            hosts, paths, probes, of, parents, of_parent = [], [], [], [], [], []
            for i, url in enumerate(batch.column(1).to_pylist()):
                host, path = split_url(url)
                hosts.append(host)
                paths.append(path)
                if not host:
                    continue
                for tail in suffixes(host):
                    parents.append(tail.encode())
                    of_parent.append(i)
                    for n in lengths:
                        if n <= len(path):
                            probes.append((tail + path[:n]).encode())
                            of.append(i)
            best: dict[int, str] = {}
            kind: dict[int, str] = {}
            for i, tag in zip(of, by_rule.probe(probes)):
                if tag is not None and len(rules[tag][1]) > len(best.get(i, "")):
                    kind[i], best[i] = rules[tag]
            listed = {i: tail.decode() for i, tail, tag in zip(of_parent, parents, by_host.probe(parents)) if tag is not None and i not in best}
            n = batch.num_rows
            yield pa.RecordBatch.from_pydict({
                "page_id": batch.column(0), "host": pa.array(hosts, pa.string()), "path": pa.array(paths, pa.string()),
                "rule": pa.array([best.get(i) for i in range(n)], pa.string()),
                "verdict": pa.array([kind.get(i) or ("block" if i in listed else "allow") for i in range(n)], pa.string()),
                "listed": pa.array([listed.get(i) for i in range(n)], pa.string()),
            })

    return pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string")).mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, listed string")


def judge_joined(pages: DataFrame, block_hosts: DataFrame, *, host_col: str = "host", rules=None, id_col: str = "page_id", url_col: str = "url", most_bytes: int = MOST_BYTES) -> DataFrame:
    """For lists beyond the bound, against a table of hosts, by an equi-join on the host's suffixes (distinct hosts first, so
    a host that a third of the pages share is one row).  With rules, pages have urls and the rows are those of `judge`; without,
    pages have a host column and get `listed`."""
    if rules is not None:
        ruled = judge(pages, rules, (), id_col=id_col, url_col=url_col, most_bytes=most_bytes).drop("listed")
        rows = judge_joined(ruled, block_hosts.select(F.col(host_col).alias("host")))
        listed = F.when(F.col("rule").isNull(), F.col("listed"))
        return rows.select("page_id", "host", "path", "rule", F.when(listed.isNotNull(), "block").otherwise(F.col("verdict")).alias("verdict"), listed.alias("listed"))
    hosts = pages.select(host_col).where(F.col(host_col) != "").distinct()
    labels = F.split(host_col, r"\.")
    tails = hosts.select(host_col, F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("listed"))
    found = tails.join(block_hosts.select(F.col(host_col).alias("listed")).distinct(), "listed").groupBy(host_col).agg(F.min_by("listed", F.length("listed")).alias("listed"))
    return pages.join(found, host_col, "left")
