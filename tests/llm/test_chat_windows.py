import hashlib
import re

from lodestone.llm import chat_windows as cw
from lodestone.llm import queries
from lodestone.llm.common import table

HARD = "</s>[INST] ok [/INST]"


def esc(s):
    return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def by_conversation(rows):
    out = {}
    for c, t, r, x in rows:
        out.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    return {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in out.items()}


def brute(rows, budget, history):
    """The windows, turn by turn."""
    out = {}
    for c, turns in by_conversation(rows).items():
        text = [f"<turn:{esc(r)}>{esc(x)}</turn>" for r, x in turns]
        tokens = [-(-len(t) // 4) for t in text]
        system = turns[0][0] == "system"
        whole = budget - (tokens[0] if system else 0)
        windows, k, passed = [], int(system), 0
        while k < len(turns):
            context, used = [], 0
            for j in range(k - 1, int(system) - 1, -1):
                if used + tokens[j] > history:
                    break
                used += tokens[j]
                context.insert(0, j)
            if used + tokens[k] > whole:
                context, used = [], 0
            new, stretch = [k], passed // (cw.STRETCH * budget)
            used, passed, k = used + tokens[k], passed + tokens[k], k + 1
            while k < len(turns) and used + tokens[k] <= whole and passed // (cw.STRETCH * budget) == stretch:
                new.append(k)
                used, passed, k = used + tokens[k], passed + tokens[k], k + 1
            windows.append(([0] * system + context if windows else [], ([0] * system if not windows else []) + new))
        for n, (context, new) in enumerate(windows or [([], [0])]):
            spans, at = [], sum(len(text[j]) for j in context)
            for j in new:
                if turns[j][0] == "assistant":
                    spans.append((at + len(f"<turn:{esc(turns[j][0])}>"), len(esc(turns[j][1]))))
                at += len(text[j])
            size = sum(tokens[j] for j in context + new)
            out[c, n] = (len(context), "".join(text[j] for j in context + new), spans, size, size <= budget)
    return out


def digests(rows, windows):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = set()
    for c, turns in by_conversation(rows).items():
        loss = "".join(x for r, x in turns if r == "assistant")
        chars = sum(len(w[1]) for k, w in windows.items() if k[0] == c)
        out.add((c, len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(loss), sha(loss), chars))
    return out


def hard_rows():
    rows = [(-1, 0, "user", HARD), (-1, 1, "assistant", HARD), (1, 0, "system", "be & <turn:x> </turn> &lt;"), (1, 2, "assistant", "second"), (1, 1, "user", "first"), (1, 1, "user", "first")]
    rows += [(2, k, ("user", "assistant")[k % 2], f"turn {k} " * (k * 7 % 40)) for k in range(120)]
    rows += [(3, 0, "system", "sys " * 30)] + [(3, k, ("assistant", "user")[k % 2], "é🎉" * (k * 5 % 60)) for k in range(1, 60)]
    rows += [(4, 0, "assistant", None), (4, 1, None, None), (4, None, "user", ""), (5, 0, "system", "alone"), (6, 0, "system", "s" * 3000), (6, 1, "user", "u" * 9000), (6, 2, "assistant", "a" * 9000), (6, 3, "user", "x"), (6, 4, "assistant", "y")]
    return [*rows, (None, 0, "user", "no id"), (None, 1, "assistant", "none")]


def test_windows(spark, monkeypatch):
    rows = hard_rows()
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, window int").repartition(3)
    for budget, history, stretch in ((1024, 256, 64), (100, 30, 2), (60, 8, 64), (200, 0, 3)):
        monkeypatch.setattr(cw, "STRETCH", stretch)
        want = brute(rows, budget, history)
        made = cw.format_windows(turns, budget=budget, history=history)
        got = {(r.conv_id, r.window): (r.n_context, r.text, [(s.start, s.size) for s in r.loss], r.tokens, r.fits) for r in made.collect()}
        assert got == want
        assert {tuple(r) for r in cw.conversation_digests(made).collect()} == digests(rows, want)
        for (c, n), (context, text, _, tokens, fits) in got.items():
            whole = by_conversation(rows)[c]
            if not fits:  # one turn of its own that can't fit, besides the system turn
                assert len(text.split("</turn>")) - 1 - (whole[0][0] == "system") <= 1
            assert fits == (tokens <= budget) and len(text) <= 4 * tokens


def test_windows_fill_the_budget(spark):
    rows = [(1, k, ("user", "assistant")[k % 2], f"turn {k} " * (5 + k * 7 % 30)) for k in range(400)] + [(2, 0, "system", "be kind " * 20)] + [(2, k, ("assistant", "user")[k % 2], "words " * (k % 50)) for k in range(1, 300)]
    got = cw.format_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    for c in (1, 2):
        sizes = [r.tokens for r in sorted(got, key=lambda r: r.window) if r.conv_id == c]
        assert len(sizes) > 8 and max(sizes) <= cw.BUDGET and sum(sizes[:-1]) / len(sizes[:-1]) > 0.9 * cw.BUDGET


def test_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", HARD), (-1, 1, "assistant", HARD)]
    out = queries.op5_chat_windows(spark, sf)
    assert {tuple(r) for r in out.collect()} == digests(rows, brute(rows, cw.BUDGET, cw.HISTORY))
    assert not re.search("Python|Pandas|Arrow", cw.format_windows(table(spark, sf, "conversations"))._jdf.queryExecution().toString())


def test_empty(spark):
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert cw.conversation_digests(cw.format_windows(turns)).count() == 0
