import random
import re

import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from readlake.functions import flat
from readlake.functions import sequences as S


def brute_dust(seq, window=64):
    s = [c for c in seq.upper().replace("U", "T") if c in "ACGT"]
    words = ["".join(s[i : i + 3]) for i in range(len(s) - 2)]
    n = len(words)
    if n < 2:
        return 0.0
    score = lambda w: 200 * sum(w.count(x) * (w.count(x) - 1) // 2 for x in set(w)) / (len(w) * (len(w) - 1))
    return score(words) if n <= window else max(score(words[e - window + 1 : e + 1]) for e in range(window, n))


@pytest.mark.parametrize(("seq", "score"), [("aaaaaaaaaa", 100), ("acgt", 0), ("aaa", 0), ("aa", 0), ("", 0), ("nnnn", 0)])
def test_dust_examples(seq, score):
    assert flat.dust_scores(flat.Flat(pa.array([seq]))).tolist() == [score]


@given(st.lists(st.text("acgtnACGT", max_size=200), max_size=8))
def test_dust_equals_the_definition(seqs):
    got = flat.dust_scores(flat.Flat(pa.array(seqs, pa.string()))).tolist()
    assert got == pytest.approx([brute_dust(s) for s in seqs]) and all(0 <= x <= 100 for x in got)


def brute_line(cigar, md, back):
    """A match line operation by operation, base by base."""
    if not cigar or cigar == "*" or md is None:
        return None
    told = [c for n, _, base in re.findall(r"([0-9]+)|\^([A-Za-z]+)|([A-Za-z])", md) for c in ("." * int(n) if n else base.upper())]
    line = ""
    for n, op in re.findall(r"([0-9]+)([MIDNSHP=X])", cigar):
        for _ in range(int(n)):
            if op in "M=X":
                line += told.pop(0) if told else "."
            elif op in "IS":
                line += "-"
    return line[::-1].translate(str.maketrans(flat.LETTERS, flat.COMPLEMENTS)) if back else line


MATCH_LINES = [("5M", "5", False, "....."), ("5M", "2A2", False, "..A.."), ("5M", "2A2", True, "..T.."), ("5M", "0C4", True, "....G"), ("2S3M", "3", False, "--..."), ("2M1I2M", "4", False, "..-.."), ("2M1D2M", "2^A2", False, "...."), ("3H4M", "4", False, "...."), ("4M", None, False, None), ("*", "4", False, None), ("2M", "1R0", True, "Y.")]


@pytest.mark.parametrize(("cigar", "md", "back", "line"), MATCH_LINES)
def test_match_lines(cigar, md, back, line):
    assert brute_line(cigar, md, back) == line
    assert flat.match_lines(pa.array([cigar]), pa.array([md], pa.string()), pa.array([back])).to_pylist() == [line]


def test_match_lines_of_batches():
    rng = random.Random(5)
    cigars = [rng.choice([None, "*", ""]) if rng.random() < 0.1 else "".join(f"{rng.choice([1, 2, 12, 105])}{rng.choice('MIDNSHP=X')}" for _ in range(rng.randrange(1, 6))) for _ in range(3000)]
    mds = [rng.choice([None, ""]) if rng.random() < 0.1 else "".join(rng.choice(["", "0", "3", "140"]) + rng.choice(["^" + "".join(rng.choices("ACGTn", k=rng.randrange(1, 4))) + "0", rng.choice("ACGTnRy")]) for _ in range(rng.randrange(1, 7))) for _ in range(3000)]
    backs = [rng.random() < 0.5 for _ in cigars]
    whole = flat.match_lines(pa.array(cigars), pa.array(mds), pa.array(backs))
    assert whole.to_pylist() == [brute_line(*x) for x in zip(cigars, mds, backs, strict=True)]
    assert flat.match_lines(pa.array(cigars).slice(7, 9), pa.array(mds).slice(7, 9), pa.array(backs).slice(7, 9)).equals(whole.slice(7, 9))


def test_round_trips(spark):
    random.seed(1)
    seqs = ["", "n", "a", "nn", "AACCCT", "nnACGTnnnACnnGTn"] + ["".join(random.choice("acgtnNRy") for _ in range(random.randint(1, 80))) for _ in range(200)]
    df = spark.createDataFrame([(s,) for s in seqs], "s string")
    s = F.col("s")
    rows = df.select(
        "s", S.reverse_complement(S.reverse_complement(s)).alias("rc"), S.expanded(S.collapsed(s), S.run_ends(s)).alias("hoco"), S.collapsed(s).alias("c"), S.run_ends(s).alias("ends"),
        S.scaffold(S.contigs(s, 3), S.gaps(s, 3)).alias("joined"), S.contigs(s, 3).alias("contigs"), S.gaps(s, 3).alias("gaps"), S.overlaid(F.regexp_replace(s, "[^ACGTacgt]", "a"), S.exceptions(s)).alias("laid"), S.exceptions(s).alias("ex"),
    ).collect()
    for r in rows:
        assert r.rc == r.s and r.hoco == r.s and r.laid == r.s
        plain = "".join(c if c in "ACGTacgt" else "n" for c in r.s)
        assert "".join(c if c in "ACGTacgt" else "n" for c in r.joined) == plain
        assert len(r.gaps) == len(r.contigs) + 1 or not r.contigs
        assert sum(e.run for e in r.ex) == sum(c not in "ACGTacgt" for c in r.s)
    by = {r.s: r for r in rows}
    assert (by["AACCCT"].c, by["AACCCT"].ends) == ("ACT", [2, 5, 6])
    assert (by["nnACGTnnnACnnGTn"].contigs, by["nnACGTnnnACnnGTn"].gaps) == (["ACGT", "ACnnGT"], [2, 3, 1])


def test_flags(spark):
    df = spark.createDataFrame([("16",), ("0x10",), ("020",), ("0",), ("x",)], "f string")
    assert [r.n for r in df.select(S.flag_number(F.col("f")).alias("n")).collect()] == [16, 16, 16, 0, None]
