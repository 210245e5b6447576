"""SQL of the queries for DuckDB, written apart from the DataFrame code: common tables first, one statement a query after."""

from __future__ import annotations

_COMMON = {
    "genome": """SELECT * FROM (SELECT doc_id AS tid, 'chr' || CAST(doc_id AS VARCHAR) AS chrom,
  translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ACGTACGTACGTACGTACGTACGTCG') AS seq FROM documents) WHERE length(seq) >= 100""",
    "site": """SELECT tid, chrom, p AS pos1, substr(seq, p, 1) AS ref, substr('NN' || seq || 'NN', p, 5) AS five
  FROM (SELECT tid, chrom, seq, CAST(unnest(range(1, length(seq) + 1)) AS BIGINT) AS p FROM genome)""",
    "aln0": """SELECT e.event_id AS e, g.tid, g.chrom, g.seq AS gseq, length(g.seq) AS clen, CAST(e.event_id * 37 % (length(g.seq) - 60) + 1 AS BIGINT) AS pos1,
  (e.event_id // 2) % 2 AS bs, e.event_id % 5 AS pat FROM events e JOIN genome g ON g.tid = (e.event_id * 7919) % (SELECT count(*) FROM documents)""",
    "aln1": """SELECT *, CASE pat WHEN 2 THEN 45 WHEN 3 THEN 52 WHEN 4 THEN 47 ELSE 50 END AS span, substr(gseq, pos1, 52) AS r FROM aln0""",
    "aln2": """SELECT *, array_to_string(list_transform(range(0, span), lambda i: CASE
   WHEN (tid * 31 + pos1 + i) % 97 = 0 AND (e + pos1 + i) % 2 = 0 THEN translate(substr(r, i + 1, 1), 'ACGT', 'CGTA')
   WHEN bs = 0 AND substr(r, i + 1, 1) = 'C' AND (e + pos1 + i) % 3 <> 0 THEN 'T'
   WHEN bs = 1 AND substr(r, i + 1, 1) = 'G' AND (e + pos1 + i) % 3 <> 0 THEN 'A' ELSE substr(r, i + 1, 1) END), '') AS s FROM aln1""",
    "aln": """SELECT e AS rid, (e // 4) % 2 AS sid, 'r' || CAST(e // 2 AS VARCHAR) AS qname,
  1 + CASE WHEN e % 11 <> 0 THEN 2 ELSE 0 END + CASE WHEN bs = 1 THEN 16 ELSE 0 END + CASE WHEN e % 2 = 0 THEN 64 ELSE 128 END + CASE WHEN e % 17 = 0 THEN 256 ELSE 0 END
  + CASE WHEN e % 19 = 0 THEN 512 ELSE 0 END + CASE WHEN e % 13 = 0 THEN 1024 ELSE 0 END + CASE WHEN e % 23 = 0 THEN 4 ELSE 0 END AS flag,
  tid, chrom, pos1, span, e * 7 % 61 AS mapq, CASE pat WHEN 2 THEN '5S45M' WHEN 3 THEN '20M2D30M' WHEN 4 THEN '25M3I22M' ELSE '50M' END AS cigar,
  greatest(1, pos1 + e % 41 - 20) AS mpos1, e * 11 % 1200 - 100 AS isize,
  CASE pat WHEN 2 THEN 'ACGTA' || s WHEN 3 THEN substr(s, 1, 20) || substr(s, 23, 30) WHEN 4 THEN substr(s, 1, 25) || 'GTC' || substr(s, 26, 22) ELSE s END AS seq,
  array_to_string(list_transform(range(1, 51), lambda i: chr(CAST(43 + (e * 3 + i * 7) % 31 AS INTEGER))), '') AS qual,
  CASE WHEN e % 3 > 0 THEN e % 4 END AS NM, CASE WHEN e % 5 > 0 THEN 35 + e % 21 END AS "AS", CASE WHEN e % 2 = 0 THEN '48M' END AS MC,
  CASE e % 8 WHEN 0 THEN 'f' WHEN 1 THEN 'r' WHEN 2 THEN 'u' WHEN 3 THEN 'c' END AS YD, CASE e % 8 WHEN 4 THEN '++' WHEN 3 THEN '-+' END AS ZS, CASE e % 8 WHEN 5 THEN 'CT' WHEN 6 THEN 'GA' END AS XG,
  CASE WHEN e % 2 = 0 THEN 48 ELSE span END AS mspan, substr('NN' || gseq || 'NN', pos1, span + 4) AS slice FROM aln2""",
    "kept": """SELECT * FROM aln WHERE flag & 4 = 0 AND mapq >= 40 AND flag & 256 = 0 AND flag & 1024 = 0 AND (flag & 1 = 0 OR flag & 2 <> 0) AND flag & 512 = 0
  AND coalesce("AS" >= 40, true)""",
    # columns of reads: pieces of the CIGAR, with what comes before each
    "piece": """SELECT rid, right(o, 1) AS op, CAST(left(o, length(o) - 1) AS BIGINT) AS n, k FROM
  (SELECT rid, unnest(regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]')) AS o, unnest(range(1, 1 + len(regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]')))) AS k FROM aln)""",
    "offset": """SELECT *, coalesce(sum(CASE WHEN op IN ('M', 'I', 'S') THEN n ELSE 0 END) OVER w, 0) AS q0, coalesce(sum(CASE WHEN op IN ('M', 'D') THEN n ELSE 0 END) OVER w, 0) AS r0,
  coalesce(sum(n) OVER w, 0) AS c0 FROM piece WINDOW w AS (PARTITION BY rid ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "step": "SELECT rid, op, q0, r0, c0, CAST(unnest(range(0, n)) AS BIGINT) AS j FROM offset_",
    "px": """SELECT a.*, t.op, CAST(c0 + j + 1 AS BIGINT) AS col, CASE WHEN op <> 'D' THEN CAST(q0 + j + 1 AS BIGINT) END AS qpos, CASE WHEN op IN ('M', 'D') THEN CAST(a.pos1 + r0 + j AS BIGINT) END AS rpos,
  CASE WHEN op <> 'D' THEN substr(seq, CAST(q0 + j + 1 AS BIGINT), 1) END AS qb, CASE WHEN op <> 'D' THEN ascii(substr(qual, CAST(q0 + j + 1 AS BIGINT), 1)) - 33 END AS bq,
  CASE WHEN op IN ('M', 'D') THEN substr(slice, CAST(r0 + j + 3 AS BIGINT), 1) END AS rb, CASE WHEN op IN ('M', 'D') THEN substr(slice, CAST(r0 + j + 1 AS BIGINT), 5) END AS five
  FROM aln a JOIN step t USING (rid)""",
    "inferred": """SELECT rid, count(*) FILTER (rb = 'C' AND qb = 'T') AS c2t, count(*) FILTER (rb = 'G' AND qb = 'A') AS g2a FROM px WHERE op = 'M' GROUP BY rid""",
    "strand": """SELECT rid, c2t, g2a, coalesce(CASE WHEN YD = 'f' THEN 0 WHEN YD = 'r' THEN 1 END, CASE WHEN ZS LIKE '+%' THEN 0 WHEN ZS LIKE '-%' THEN 1 END,
  CASE WHEN XG = 'CT' THEN 0 WHEN XG = 'GA' THEN 1 END, CASE WHEN c2t >= g2a THEN 0 ELSE 1 END) AS bss,
  coalesce(CASE WHEN ZS LIKE '+%' THEN 'f' WHEN ZS LIKE '-%' THEN 'r' END, YD, CASE WHEN XG = 'CT' THEN 'f' WHEN XG = 'GA' THEN 'r' END, 'u') AS tag,
  CASE WHEN c2t = 0 AND g2a = 0 THEN 'u' WHEN c2t = g2a THEN 'c' WHEN c2t > g2a THEN 'f' ELSE 'r' END AS own FROM aln JOIN inferred USING (rid)""",
    # bases that count: kept reads, both filters, strand known
    "base": """SELECT px.*, bss FROM px JOIN strand USING (rid) WHERE rid IN (SELECT rid FROM kept) AND op = 'M'""",
    "good": """SELECT * FROM base WHERE bq >= 20 AND qpos > 3 AND qpos + 3 <= 50
  AND NOT (flag & 128 <> 0 AND rpos >= greatest(pos1, mpos1) AND rpos <= least(pos1 + span - 1, mpos1 + mspan - 1))""",
}

_NEEDS = {
    "genome": (), "site": ("genome",), "aln0": ("genome",), "aln1": ("aln0",), "aln2": ("aln1",), "aln": ("aln2",), "kept": ("aln",), "piece": ("aln",), "offset": ("piece",), "step": ("offset",),
    "px": ("aln", "step"), "inferred": ("px",), "strand": ("aln", "inferred"), "base": ("px", "strand", "kept"), "good": ("base",),
}


def define(name: str, sql: str, *needs: str) -> None:
    """A further common table."""
    _COMMON[name], _NEEDS[name] = sql, needs


def with_tables(sql: str, *needs: str) -> str:
    order: list[str] = []

    def add(n: str) -> None:
        for m in _NEEDS[n]:
            add(m)
        if n not in order:
            order.append(n)

    for n in needs:
        add(n)
    name = lambda n: "offset_" if n == "offset" else n
    return "WITH " + ",\n".join(f"{name(n)} AS MATERIALIZED ({_COMMON[n]})" for n in order) + "\n" + sql
