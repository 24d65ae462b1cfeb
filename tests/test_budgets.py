"""Token budgets against cutting character by character."""

import numpy as np
import pytest

from palimpsest.functions import budgets as B

PATH = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokens():
    return B.Tokens(PATH)


def brute(tail, tokens, most):
    for n in range(len(tail.body), -1, -1):
        if tokens.count(tail.at(n)) <= most:
            return tail.at(n)
    return None


def test_tail_as_character_by_character(tokens):
    rng = np.random.default_rng(1)
    words = ["case", "extraordinarily", "Zürich", "\n", "x1", "2.0", "policy@1.1", "don't", "  ", "ﬁne", "漢字", "éte", "ΣΑΣ"]
    for i in range(60):
        body = " ".join(words[k] for k in rng.integers(0, len(words), 25))
        text = (B.SYSTEM + "\n" if i % 2 else "") + body + ("\nCurrent policy: keep all records" if i % 3 else "")
        tail = B.Tail.of(text)
        for most in (5, 14, 20, 30, 200):
            assert tail.longest(tokens, most) == brute(tail, tokens, most)


def test_steps(tokens):
    text = f"{B.SYSTEM}\nCase 7 is about seals\nExamples:\n{'one example ' * 30}\nPolicy history:\n{'old rule ' * 30}\nCurrent policy:\n[POL-A@2.0] keep\n[POL-A@1.0] superseded {'by much ' * 20}\nTool schema: x"
    assert B.fit_prompt(text, tokens, 10_000) == (text, [])
    done = {n: B.fit_prompt(text, tokens, n) for n in (170, 110, 40, 20)}
    assert done[170][1] == [B.REMOVED_EXAMPLES] and "one example" not in done[170][0] and "old rule" in done[170][0]
    assert done[110][1] == [B.REMOVED_EXAMPLES, B.REMOVED_HISTORY] and "old rule" not in done[110][0] and "superseded" in done[110][0]
    assert done[40][1][:3] == [B.REMOVED_EXAMPLES, B.REMOVED_HISTORY, B.TRIMMED_OLDER] and "superseded" not in done[40][0] and "[POL-A@2.0] keep" in done[40][0]
    assert B.CUT_TAIL in done[20][1] and B.LOST_TOOLS in done[20][1]
    assert B.fit_prompt("", tokens, 0) == ("", [])


def test_first_tokens(tokens):
    text = "The extraordinarily long completion, of éte and 漢字 @ 2.0"
    n = tokens.count(text)
    for most in range(n + 1):
        cut = B.first_tokens(text, tokens, most)
        assert text.startswith(cut) and tokens.count(cut) <= most
    assert B.first_tokens(text, tokens, n) == text


def test_pieces_as_whole_texts():
    """Counts and ends by pieces against tokenizing the text at once; known pieces are not tokenized again."""
    from tokenizers import Tokenizer

    whole, tokens = Tokenizer.from_file(PATH), B.Tokens(PATH)
    text = "Zürich's ΣΑΣ, e\u0301te\u00a0漢字\x1c!\x1c! <|endoftext|> I'LL\n\tfind_2.0 İx  ﬁne don't " * 40
    for t in (text, "", " \n", "x" * 300, text + "y" * 70):
        got = whole.encode(t, add_special_tokens=False)
        assert tokens.count(t) == len(got)
        assert [i for p in tokens.each(tokens.PIECE.findall(t)) for i in p] == got.ids
        assert [tokens.end(t, n) for n in range(1, len(got) + 1, 7)] == [got.offsets[n - 1][1] for n in range(1, len(got) + 1, 7)]
    tokens.count("x")
    tokens.encoded = None
    assert tokens.count(text + " x" + "\nI'LL") > 0


def test_report_fits_each_pair_once(spark):
    pairs = spark.createDataFrame([(1, "a", "b", "c")], "id long, prompt string, chosen string, rejected string")
    plan = B.report(B.fit_pairs(pairs, "id", B.Budget(tokenizer=PATH)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_documents_of_one_file_are_many_tasks(spark, sf):
    from palimpsest.plans.catalog_domain import token_pairs
    from palimpsest.plans.projection import World

    assert token_pairs(World(spark, sf)).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_pairs_and_report(spark):
    with pytest.raises(ValueError):
        B.Budget(10, 8, 8)
    rows = [(1, "short", "yes", "no"), (2, "word " * 900, "same " * 200 + "a", "same " * 200 + "b"), (3, None, "x", None), (4, "Current policy: a\nTools: [", "x y", "x y z")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "id long, prompt string, chosen string, rejected string, survived int").repartition(2)
    fitted = B.fit_pairs(df, "id", B.Budget(tokenizer=PATH))
    got = {r.id: r for r in fitted.collect()}
    assert (got[1].prompt, got[1].first_difference, got[1].survived, got[1].warnings) == ("short", 0, True, [])
    assert got[2].prompt_tokens <= 384 and got[2].chosen_tokens == got[2].rejected_tokens == 128 and not got[2].survived and got[2].first_difference is None
    assert got[2].warnings == [B.CUT_TAIL, "chosen_completion_truncated_from_end:201->128", "rejected_completion_truncated_from_end:201->128", B.IDENTICAL]
    assert (got[3].prompt, got[3].rejected_tokens, got[3].survived) == ("", 0, True)
    assert (got[4].first_difference, got[4].policy_kept, got[4].tools_kept) == (2, True, True)
    r = B.report(fitted).first()
    assert (r.n, r.percent, r.empty, r.passed) == (4, 75.0, 1, False) and r.warnings["chosen_completion_truncated_from_end"] == 1
    assert {x.name for x in r.lengths} >= {"prompt", "chosen_completion", "rejected_completion", "chosen_loss", "rejected_loss"}
    assert B.report(fitted.limit(0)).first().passed is False
