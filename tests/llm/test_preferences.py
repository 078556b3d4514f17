from tagsift.llm.preferences import format_preferences, swapped_last_reply
from tagsift.llm.queries_chat import OP8_SQL, op8_preferences
from tests.conftest import SMALL
from tests.oracle_compare import compare_one, duck_connection

SCHEMA = "pair_id long, turn long, role string, text string, chosen int"


def render(turns):
    return "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in turns)


def test_query_against_sql(spark):
    info = compare_one(spark, duck_connection(SMALL), "op8", op8_preferences, OP8_SQL, SMALL)
    assert info["ok"], info


def test_prefix_masks_and_cases(spark):
    a = [(1, 0, "user", "hé"), (1, 1, "assistant", "yes"), (1, 2, "user", "why"), (1, 3, "assistant", "<|end|>x"),
         (2, 0, "user", "u"), (3, None, None, None), (3, 5, "assistant", ""), (None, 0, "user", "n"), (5, 1, "user", "same"),
         (5, 1, "user", "same"), (7, 0, "assistant", "y" * 200_000)]
    b = [(1, 0, "user", "hé"), (1, 1, "assistant", "yes"), (1, 2, "user", "why"), (1, 3, "assistant", "no"), (1, 4, "assistant", "z"),
         (3, None, "", ""), (None, 0, "user", "m"), (4, 0, "assistant", "only here"), (5, 1, "user", "same"), (5, 1, "user", "same")]
    df = [spark.createDataFrame([(*r, 0) for r in x], SCHEMA) for x in (a, b)]
    out = {r.pair_id: r for r in format_preferences(*df).collect()}
    assert set(out) == {1, 2, 3, 4, 5, 7, None}
    one = out[1]
    assert one.prompt == render([("user", "hé"), ("assistant", "yes"), ("user", "why")]) and one.n_common == 3
    assert one.chosen == render([("assistant", "< |end|>x")])
    assert one.rejected == render([("assistant", "no"), ("assistant", "z")])
    assert [one.rejected[slice(*map(int, s.split(":")))] for s in one.rejected_mask.split(",")] == ["no", "z"]
    assert [one.chosen[slice(*map(int, s.split(":")))] for s in one.chosen_mask.split(",")] == ["< |end|>x"]
    assert (out[2].prompt, out[2].chosen, out[2].rejected) == ("", render([("user", "u")]), "")
    assert out[3].n_common == 1 and out[3].rejected == "" and out[3].chosen_mask == "14:14"
    assert (out[4].chosen, out[4].rejected_mask) == ("", "14:23")
    assert out[5].n_common == 2 and out[5].chosen == out[5].rejected == ""
    assert out[None].chosen == render([("user", "n")]) and out[None].rejected == render([("user", "m")])
    assert len(out[7].chosen) > 200_000
    assert format_preferences(df[0].limit(0), df[1].limit(0)).count() == 0


def test_swapped_replies(spark):
    rows = [(2, 0, "user", "q"), (2, 1, "assistant", "a2"), (3, 0, "user", "r"), (3, 1, "assistant", "a3"), (3, 2, "user", "t"),
            (4, 0, "user", "alone"), (4, 1, "assistant", "gone"), (None, 0, "assistant", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {tuple(r) for r in swapped_last_reply(df).collect()}
    assert got == {(2, 0, "user", "q"), (2, 1, "assistant", "a3"), (3, 0, "user", "r"), (3, 1, "assistant", "a2"), (3, 2, "user", "t"),
                   (4, 0, "user", "alone"), (None, 0, "assistant", "n")}
