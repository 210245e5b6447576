"""Fragments of both mates, against a dictionary of places."""

import random
import re

from cytolake.operators import fragments

SCHEMA = "sid int, rid long, qname string, flag int, chrom string, pos1 int, cigar string, seq string, qual string, NM int"
COMP = str.maketrans("ACGTN", "TGCAN")


def places(pos1, cigar, seq, qual):
    out, q, r = {}, 0, pos1 - 1
    for n, op in re.findall(r"(\d+)([MIDS])", cigar):
        for _ in range(int(n)):
            if op == "M":
                out[r] = (seq[q], qual[q])
            if op == "D":
                out[r] = ("N", "B")
            q, r = q + (op in "MIS"), r + (op in "MD")
    return out


def test_fragments_against_places(spark):
    rnd = random.Random(6)
    rows, want = [], []
    for k in range(400):
        back, at = k % 2, rnd.randrange(1, 500)
        mates = []
        for m in (1, 2):
            cigar = rnd.choice(["20M", "3S17M", "8M2D12M", "8M3I9M", "15M5S"])
            left = (m == 2) == bool(back)  # the mate that lies to the left
            pos1 = at if left else max(1, at + rnd.randrange(-4, 40))
            flag = 1 + (64 if m == 1 else 128) + (16 if (m == 1) == bool(back) else 0) + (1024 if k % 37 == 5 and m == 2 else 0)
            mates.append((k % 3, 2 * k + m, f"q{k // 3}", flag, "c2" if k % 41 == 7 and m == 1 else "c1", pos1, cigar, "".join(rnd.choice("ACGT") for _ in range(20)), "".join(chr(35 + rnd.randrange(40)) for _ in range(20)), rnd.choice([None, 0, 2])))
        rows += mates if k % 53 else mates[:1]
        if k % 50 == 9:
            rows.append(mates[0])  # more than one read 1
        if k % 53 == 0 or k % 50 == 9 or k % 37 == 5 or mates[0][4] != mates[1][4]:
            continue
        p1, p2 = (places(*x[5:9]) for x in mates)
        beg, end = (min(p2), max(p1) + 1) if back else (min(p1), max(p2) + 1)
        if not 1 <= end - beg <= 60:
            continue
        got = [p1.get(p) or p2.get(p) or ("N", "B") for p in range(beg, end)]
        # a mate that begins behind the other's end reaches no place twice; one that begins before it is cut where the fragment begins
        s, q = "".join(x for x, _ in got), "".join(x for _, x in got)
        want.append((k % 3, "c1", beg, end, f"q{k // 3}", sum(x[9] or 0 for x in mates), "-" if back else "+", s.translate(COMP)[::-1] if back else s, q[::-1] if back else q))
    got = sorted(tuple(r) for r in fragments.merged(spark.createDataFrame(rows, SCHEMA), longest=60).collect())
    assert len(want) > 200 and got == sorted(want)


def test_fragments_of_nothing(spark):
    assert fragments.merged(spark.createDataFrame([], SCHEMA)).collect() == []
