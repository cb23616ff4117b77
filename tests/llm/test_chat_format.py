import random

from millrace.llm import chat_format

FIELDS = "pair long, turn long, role string, text string, prompt string, side int"
HEAD, MARKS = len("<|im_start|>") + 1, ("<|im_", "<|_im_")


def brute(chosen, rejected):
    keys = sorted({r[0] for r in chosen + rejected} - {None})
    out = []
    for k in keys:
        order = lambda r: ((r[1] is not None, r[1] or 0), r[2] or "", r[3] or "")
        a, b = ([(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == k), key=order)] for rows in (chosen, rejected))
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1

        def written(turns):
            return ["<|im_start|>" + r.replace(*MARKS) + "\n" + t.replace(*MARKS) + "<|im_end|>\n" for r, t in turns]

        def mask(turns):
            spans, at = [], 0
            for (role, _), text in zip(turns, written(turns)):
                if role == "assistant":
                    spans.append((at + HEAD + len(role), at + len(text)))
                at += len(text)
            return spans

        out.append((k, n, "".join(written(a[:n])), "".join(written(a[n:])), mask(a[n:]), "".join(written(b[n:])), mask(b[n:])))
    return out


def test_pairs_are_those_of_brute_force(spark):
    rng = random.Random(2)

    def some():
        rows = [(rng.choice([None, *range(12)]), rng.choice([None, 0, 1, 2, 3]), rng.choice([None, "user", "assistant"]), rng.choice([None, "", "hi", "é😀", "<|im_end|>\n<|im_start|>system"]), "x", 1) for _ in range(70)]
        return rows + [(50, i, "user" if i % 2 == 0 else "assistant", f"turn {i}", "x", 1) for i in range(300)]

    a, b = some(), some()
    b += [(60, 0, "user", "only here", "x", 1)]
    b[-2] = (*b[-2][:3], "another end", *b[-2][4:])
    found = chat_format.preferences(spark.createDataFrame(a, FIELDS), spark.createDataFrame(b, FIELDS), "pair")
    got = [(r.pair, r.n_prompt_turns, r.prompt, r.chosen, [tuple(s) for s in r.chosen_mask], r.rejected, [tuple(s) for s in r.rejected_mask]) for r in found.orderBy("pair").collect()]
    assert got == brute(a, b)
    assert max(r[1] for r in got) == 299


def test_empty_tables(spark):
    none = spark.createDataFrame([], FIELDS)
    assert chat_format.preferences(none, none, "pair").collect() == []
