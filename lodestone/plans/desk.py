"""Questions to a code base by name, answered with small payloads; the whole ones are kept for later."""

from __future__ import annotations

from dataclasses import fields, is_dataclass
from typing import Any

from pyspark.sql import DataFrame

from lodestone.operators.analytics import Rule
from lodestone.operators.compression import PayloadStore, compressed
from lodestone.plans.cache import AnswerCache
from lodestone.plans.engine import CodeBase

#: Rows of an answer that are taken to the driver.
MOST_ROWS = 500
#: The questions, each a method of CodeBase.
QUESTIONS = ("search", "intent_search", "callers", "callees", "impact", "trace", "node", "affected", "context", "explore", "files", "status", "dead_code", "cycles", "stats", "suggest", "plan", "auto_context", "dna", "lint", "summary", "export")


def plain(answer: Any) -> Any:
    """The answer in JSON's own kinds; of a table its first MOST_ROWS rows."""
    if isinstance(answer, DataFrame):
        return [plain(r.asDict(recursive=True)) for r in answer.limit(MOST_ROWS).collect()]
    if is_dataclass(answer) and not isinstance(answer, type):
        return {f.name: plain(getattr(answer, f.name)) for f in fields(answer)}
    if isinstance(answer, dict):
        return {str(k): plain(v) for k, v in answer.items()}
    if isinstance(answer, (list, tuple)):
        return [plain(v) for v in answer]
    return answer if answer is None or isinstance(answer, (str, int, float, bool)) else str(answer)


class Desk:
    """Answers about the code base as it is now. An answer that was given a short time ago is given again; renew takes another code base."""

    def __init__(self, code: CodeBase, payloads: PayloadStore, answers: AnswerCache | None = None):
        self.code, self.payloads, self.answers = code, payloads, answers or AnswerCache()

    def renew(self, code: CodeBase) -> None:
        self.code = code
        self.answers.clear()

    def ask(self, question: str, mode: str = "coding", large: bool = False, **arguments: Any) -> dict:
        """{"data", "meta"}: the answer, shrunk, and the id under which retrieve gives the whole of it. Arguments are JSON's own kinds, rules as their fields."""
        if question not in QUESTIONS:
            raise ValueError(f"question {question}")
        given = {k: [Rule(**r) for r in v] if k == "rules" else v for k, v in arguments.items()}
        whole = self.answers.answer(question, lambda: plain(getattr(self.code, question)(**given)), **arguments)
        return compressed(self.payloads, whole, mode, large)

    def retrieve(self, payload_id: str) -> Any:
        """A whole payload; None if it isn't there (any more)."""
        return self.payloads.fetch(payload_id)
