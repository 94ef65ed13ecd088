import hashlib
import random

from pyspark.sql import functions as F

from lexcask.llm import chat_format as cf

SCHEMA = "conv_id long, turn long, role string, text string, block string, k int, text_ string"
ODD = [cf.MARKED, "<|", "<\\|", "<\\\\|x<|", "a<", "|b", "", None, "\n", "<|im_end|>\n<|im_start|>user\nhi", "é日本" * 5, "\\", "x" * 200_000]


def conversations(seed=3):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(12)]:
        for turn in range(rng.choice([1, 2, 3, 9])):
            role = rng.choice(["user", "assistant", "system", "assistant", None, "to\\ol\nx", "<|im_end|>"])
            rows.append((conv, turn, role, rng.choice(ODD) if rng.random() < 0.5 else "w" * rng.randint(0, 60)))
    rows += [(50, t, "assistant" if t % 3 else "user", f"turn {t} <|") for t in range(700)]  # a hot conversation
    rows += [(51, None, "user", "no turn"), (51, 1, "assistant", "yes"), (52, 0, "user", "only"), (53, 0, "user", "again"), (53, 0, "user", "again"), (53, 1, "assistant", "same")]
    rng.shuffle(rows)
    return [(*r, "b", 1, "z") for r in rows]


def plain(rows):
    """Digests by conversation, from the turns; formatted length from texts built one by one."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        turns = [(role, text) for _, _, role, text in turns]
        esc = lambda t: __import__("re").sub(r"<(\\*)\|", lambda m: f"<{m[1]}\\|", t)
        seg = [f"<|im_start|>{esc(r.replace(chr(92), chr(92) * 2).replace(chr(10), chr(92) + 'n'))}\n{esc(t)}<|im_end|>\n" for r, t in turns]
        shown = [i for i, (r, _) in enumerate(turns) if r == "assistant" or i == len(turns) - 1]
        loss = "".join(t for r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for r, t in turns)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(turns), sha(whole), len(loss), sha(loss), len(shown), sum(len("".join(seg[: i + 1])) for i in shown))
    return out


def test_digests_equal_those_of_the_turns_with_small_and_large_blocks(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, SCHEMA)
    want = plain(rows)
    for block in (cf.BLOCK, 300):
        got = {r[0]: tuple(r)[1:] for r in cf.digests(cf.expand(df.repartition(5), block=block)).collect()}
        assert got == want


def test_examples_are_prefixes_with_one_reply_trained(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "q<|"), (1, 2, "assistant", "a<|im_end|>"), (1, 3, "user", "r"), (1, 4, "assistant", "b"), (1, 5, "user", "left")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for block in (cf.BLOCK, 20):
        whole = {r.example: r for r in cf.whole_examples(cf.expand(df, block=block)).collect()}
        assert sorted(whole) == [2, 4, 5]
        assert whole[2].text == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nq<\\|<|im_end|>\n<|im_start|>assistant\na<\\|im_end|><|im_end|>\n"
        assert whole[2].text[whole[2].loss_start : whole[2].loss_end] == "a<\\|im_end|>"
        assert whole[4].text.startswith(whole[2].text) and whole[4].text[whole[4].loss_start : whole[4].loss_end] == "b"
        assert whole[5].text.startswith(whole[4].text) and whole[5].loss_start is None


def test_escape_is_reversible(spark):
    df = spark.createDataFrame([(t, r) for t in ODD if t is not None for r in ("a\\n\nb", "\\\\n", "<|\n\\")], "t string, r string")
    e = df.select("t", "r", cf.escape(F.col("t")).alias("e"), cf.escape_role(F.col("r")).alias("er"))
    got = e.select("t", "r", "e", "er", cf.unescape(F.col("e")).alias("u"), cf.unescape_role(F.col("er")).alias("ur")).collect()
    assert all(r.u == r.t and r.ur == r.r and "<|" not in r.e and "<|" not in r.er and "\n" not in r.er for r in got)


def test_empty_table(spark):
    out = cf.expand(spark.createDataFrame([], SCHEMA))
    assert out.examples.count() == 0 and out.blocks.count() == 0 and cf.digests(out).count() == 0


def test_a_long_conversation_takes_room_in_proportion_and_lies_in_many_groups(spark):
    df = spark.range(4000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.lit("x" * 60).alias("text"))
    sizes = []
    for n in (2000, 4000):
        out = cf.expand(df.filter(F.col("turn") < n), block=2000)
        sizes.append(out.examples.agg(F.sum(F.length("text"))).first()[0] + out.blocks.agg(F.sum(F.length("text"))).first()[0])
        assert out.examples.agg(F.max(F.length("text"))).first()[0] < 2200
    assert sizes[1] < 2.1 * sizes[0]
