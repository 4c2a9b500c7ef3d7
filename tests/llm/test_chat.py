"""Preference formatting against plain Python."""

from askgrid.llm import chat

TURNS = "conv_id long, turn long, role string, text string, n int"


def render(turn):
    role, text = turn
    mark = lambda value, default: (default if value is None else value).replace("<|", "< |")
    return f"<|{mark(role, 'unknown')}|>\n", mark(text, "") + "<|end|>\n"


def plain(chosen, rejected):
    n = 0
    while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
        n += 1

    def side(turns):
        text, ranges = "", []
        for turn in turns:
            head, body = render(turn)
            text += head
            if turn[0] == "assistant":
                ranges.append((len(text), len(text) + len(body)))
            text += body
        return text, ranges
    return n, side(chosen[:n])[0], *side(chosen[n:]), *side(rejected[n:])


def test_prefix_prompt_and_masks(spark):
    u, a = ("user", "hi <|end|> ü"), ("assistant", "yes\nno")
    cases = [([u, a], [u, a]), ([u, a, u, a], [u, a, u]), ([], [a]), ([u, (None, None)], [u, (None, None), a]),
             ([u, ("assistant", None)], [u, ("assistant", "")]), ([a, a, u], [u, a, a]), (None, [u])]
    pairs = spark.createDataFrame([(i, c, r, 1) for i, (c, r) in enumerate(cases)], (
        "pair_id int, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>, n int"))
    for row in chat.format_preferences(pairs).collect():
        chosen, rejected = cases[row.pair_id]
        got = (row.prompt_turns, row.prompt, row.chosen, [tuple(r) for r in row.chosen_ranges],
               row.rejected, [tuple(r) for r in row.rejected_ranges])
        assert got == plain(chosen or [], rejected or [])


def test_conversations_and_swapped_replies(spark):
    rows = [(2, 1, "assistant", "B"), (2, 0, "user", "A"), (2, 0, "user", "A"), (3, 0, "user", "C"), (3, 1, "assistant", "D"),
            (3, 2, "user", "E"), (4, 0, "user", "F"), (8, 0, "assistant", None), (None, 0, "user", "x"), (4, None, None, None)]
    turns = spark.createDataFrame([(*row, 1) for row in rows], TURNS)
    found = {r.pair_id: ([tuple(t) for t in r.chosen], [tuple(t) for t in r.rejected]) for r in chat.swapped_reply_pairs(turns).collect()}
    assert found == {
        2: ([("user", "A"), ("assistant", "B")], [("user", "A"), ("assistant", "D")]),
        3: ([("user", "C"), ("assistant", "D"), ("user", "E")], [("user", "C"), ("assistant", "B")]),
        4: ([(None, None), ("user", "F")], [(None, None), ("user", "F")]),
        8: ([("assistant", None)], [("assistant", "")])}
    assert chat.format_preferences(chat.swapped_reply_pairs(turns.limit(0))).count() == 0
