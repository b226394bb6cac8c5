"""URL filtering with a trie over reversed host labels and path segments.

A rule is ``(host, path, verdict)``.  It fits its host and every subdomain of
it when the URL's path starts with the rule's path.  The longest rule wins:
first the deeper host, then the longer path; of two equal rules, block.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import pick

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: The trie is broadcast only while its rules take no more than this; beyond it, `judge` takes the rules in slices.
MAX_BROADCAST_BYTES = 64 << 20
_LOWER = {i: i + 32 for i in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): after the first ``://`` to ``/``, ``?`` or ``#``; then to ``?`` or ``#``."""
    if url is None or (i := url.find("://")) < 0:
        return "", ""
    rest = url[i + 3 :]
    n = len(rest)
    q = min((k for k in (rest.find("?"), rest.find("#")) if k >= 0), default=n)
    s = rest.find("/", 0, q)
    h = q if s < 0 else s
    return rest[:h].translate(_LOWER), rest[h:q]


class Trie:
    """Nodes are ``[children, rules]``; a host's labels come last first, then path segments.

    Where a host ends, the path's trie begins: its edges are whole segments,
    and a rule's unfinished last segment is kept at its node as a prefix.
    """

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: list = [{}, None]
        for host, path, verdict in rules:
            node = self.root
            for label in reversed(host.translate(_LOWER).split(".")):
                node = node[0].setdefault(label, [{}, None])
            if node[1] is None:
                node[1] = [{}, {}]
            *whole, tail = path.split("/")
            at = node[1]
            for seg in whole:
                at = at[0].setdefault(seg, [{}, {}])
            name = host.translate(_LOWER) + path
            if at[1].get(tail, ("", "allow"))[1] != "block":
                at[1][tail] = (name, verdict)

    @staticmethod
    def _path(at: list, path: str) -> tuple[str, str] | None:
        best, segs, i = None, path.split("/"), 0
        while True:
            rest = segs[i] if i < len(segs) else ""
            fits = [t for t in at[1] if (rest.startswith(t) if i < len(segs) else not t)]
            if fits:
                best = at[1][max(fits, key=len)]
            if i >= len(segs) - 1 or (at := at[0].get(segs[i])) is None:
                return best
            i += 1

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits, or None."""
        best, node = None, self.root
        for label in reversed(host.split(".")):
            node = node[0].get(label)
            if node is None:
                break
            if node[1] is not None and (m := self._path(node[1], path)):
                best = m
        return best


def _slices(rules: list[tuple[str, str, str]], most: int) -> list[list]:
    out: list[list] = [[]]
    size = 0
    for r in rules:
        size += len(r[0]) + len(r[1])
        if size > most and out[-1]:
            out.append([])
            size = len(r[0]) + len(r[1])
        out[-1].append(r)
    return out


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, default: str = "allow", max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """(page_id, host, path, rule, verdict), one row per row of ``pages``.

    A null url, or one without ``://``, has empty host and path, no rule, and
    the default verdict.  Repeated rows are judged each; an empty table gives
    an empty result.  The column ``url`` alone decides.

    The rules are shipped as one broadcast trie.  Rule lists over ``max_bytes``
    go in slices, one narrow pass each, and the longest match of all stays.
    """
    sc = pages.sparkSession.sparkContext
    out = pick(pages, "page_id", "url")
    parts = _slices(list(rules), max_bytes)
    for k, part in enumerate(parts):
        trie = sc.broadcast(Trie(part))

        def run(batches: Iterator[pa.RecordBatch], trie=trie, first=k == 0) -> Iterator[pa.RecordBatch]:
            t = trie.value
            for b in batches:
                hosts, paths, rule, verdict = [], [], [], []
                old_r = [None] * b.num_rows if first else b.column(4).to_pylist()
                old_v = [None] * b.num_rows if first else b.column(5).to_pylist()
                for u, r0, v0 in zip(b.column(1).to_pylist(), old_r, old_v):
                    h, p = split_url(u)
                    m = t.match(h, p)
                    # of two fitting rules, the deeper host has the longer host
                    if m and (r0 is None or (m[0].find("/") % (1 << 30), len(m[0]), m[1]) > (r0.find("/") % (1 << 30), len(r0), v0)):
                        r0, v0 = m
                    hosts.append(h)
                    paths.append(p)
                    rule.append(r0)
                    verdict.append(v0)
                cols = [b.column(0), b.column(1), *(pa.array(x, pa.string()) for x in (hosts, paths, rule, verdict))]
                yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "host", "path", "rule", "verdict"])

        kind = out.schema["page_id"].dataType.simpleString()
        out = out.mapInArrow(run, f"page_id {kind}, url string, host string, path string, rule string, verdict string")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


ORACLE_SQL = r"""
WITH p AS (
  SELECT page_id,
    translate(CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*') END,
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) END AS path
  FROM pages
), r(rhost, rpath, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), m AS (
  SELECT page_id, host, path, arg_max(rhost || rpath, len(rhost) * 1000 + len(rpath)) AS rule, arg_max(verdict, len(rhost) * 1000 + len(rpath)) AS verdict
  FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY page_id, host, path
)
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM p LEFT JOIN m ON p.page_id IS NOT DISTINCT FROM m.page_id AND p.host = m.host AND p.path = m.path
"""
