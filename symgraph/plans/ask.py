"""Answering a question over an indexed repository: plan, retrieve, expand through the graph, generate, check citations.

Planner and generator are callables that the caller supplies; the engine never calls a model itself. Every stage that
fails leaves a note and the answer goes on without it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field, replace
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.functions.text import search_terms
from symgraph.operators import context, evaluate, fusion, graph, lexical, vector
from symgraph.plans.engine import Engine


@dataclass(frozen=True)
class Config:
    """Limits of one answer (fixed values), and switches for ablations."""

    top_k: int = 8
    candidates: int = 24
    threshold: float = 0.25
    max_queries: int = 3
    snippet_lines: int = 60
    anchors: int = 15
    depth: int = 3
    shallow_depth: int = 1
    fanout: int = 10
    expand: int = 6
    impact_depth: int = 3
    impact_symbols: int = 60
    followup_rounds: int = 1
    followup_items: int = 5
    chunks_an_item: int = 2
    use_planner: bool = True
    use_vector: bool = True
    use_bm25: bool = True
    use_rerank: bool = True
    use_graph: bool = True


FULL = Config()
VARIANTS = {
    "full": FULL, "no_planner": replace(FULL, use_planner=False), "vector_only": replace(FULL, use_bm25=False), "bm25_only": replace(FULL, use_vector=False),
    "no_rerank": replace(FULL, use_rerank=False), "no_graph_expansion": replace(FULL, use_graph=False),
}


@dataclass
class Plan:
    """What a planner makes of a question."""

    query_type: str = "general"
    complexity: str = "simple"
    symbols: list[str] = field(default_factory=list)
    queries: list[str] = field(default_factory=list)


class RecordedPlanner:
    """Plans read from a JSON file by question; ``record`` plans new ones with another planner and adds them."""

    def __init__(self, path: str, record: Callable[[str, list[dict]], Plan] | None = None) -> None:
        self.path, self.record = Path(path), record
        self.plans = json.loads(self.path.read_text()) if self.path.exists() else {}

    def __call__(self, question: str, history: list[dict]) -> Plan:
        key = question.strip()
        if key not in self.plans:
            if self.record is None:
                raise KeyError(f"no recorded plan for: {key}")
            self.plans[key] = asdict(self.record(question, history))
            self.path.write_text(json.dumps(self.plans, indent=1, sort_keys=True))
        return Plan(**self.plans[key])


@dataclass
class Answer:
    """Text, status (ok or degraded), checked citations, what was shown, notes of stages that failed."""

    text: str
    status: str
    citations: DataFrame
    hits: DataFrame
    expanded: DataFrame
    followups: list[list[str]]
    notes: list[str]


class Asker:
    """Questions about one repository."""

    def __init__(self, engine: Engine, url: str, planner: Callable[[str, list[dict]], Plan] | None = None, generator: Callable[[str], str] | None = None, config: Config = FULL) -> None:
        self.engine, self.url, self.planner, self.generator, self.config = engine, url, planner, generator, config

    def plan(self, question: str, history: list[dict], notes: list[str]) -> Plan:
        if self.planner is None or not self.config.use_planner:
            return Plan()
        try:
            return self.planner(question, history)
        except Exception as e:  # a planner that fails costs the plan, not the answer
            notes.append(f"planner: {e}")
            return Plan()

    def queries(self, question: str, plan: Plan) -> list[str]:
        """The question first, then the plan's queries; equal ones but for case once."""
        out: dict[str, str] = {}
        for q in [question, *plan.queries]:
            if q and q.strip():
                out.setdefault(q.strip().lower(), q.strip())
        return list(out.values())[: self.config.max_queries]

    def strategy(self, plan: Plan) -> str:
        return fusion.STRATEGIES.get(plan.query_type, "vector")

    def _terms(self, texts: list[str]) -> list[str]:
        row = self.engine.spark.createDataFrame([(texts,)], "t array<string>").select(search_terms(F.col("t")).alias("t")).first()
        return list(row.t)

    def retrieve(self, question: str, plan: Plan, notes: list[str]) -> DataFrame:
        """Fused candidates: a vector list a query, and one BM25 list if there are terms (symbols alone unless the strategy is hybrid)."""
        spark, c = self.engine.spark, self.config
        key = ["filepath", "symbol", "start_line", "rank", "score"]
        schema = "list_id int, source string, filepath string, symbol string, start_line int, rank int, score double"
        lists, n = spark.createDataFrame([], schema), 0
        queries = self.queries(question, plan)
        if c.use_vector:
            n += len(queries)
            try:
                vectors = self.engine.embedder(queries)
                asked = spark.createDataFrame(list(enumerate(vectors)), "query_id int, vector array<float>")
                found = vector.search(self.engine.store.read("vectors", self.url), asked, self.url, threshold=c.threshold)
                lists = lists.unionByName(found.select(F.col("query_id").alias("list_id"), F.lit("vector").alias("source"), *key))
            except Exception as e:
                notes.append(f"vectors: {e}")
        hybrid = self.strategy(plan) == "hybrid" or not c.use_vector
        terms = self._terms([*plan.symbols, *(queries if hybrid else [])])
        if c.use_bm25 and terms:
            n += 1
            found = self.engine.lexical(terms, tuple(lexical.FIELDS) if hybrid else ("symbol",), self.url)
            found = lexical.exact_first(found, terms)
            lists = lists.unionByName(found.select(F.lit(len(queries)).alias("list_id"), F.lit("bm25").alias("source"), *key))
        limit = c.candidates if c.use_rerank else c.top_k
        return fusion.reciprocal_rank_fusion(lists, max(1, n)).where(F.col("rank") <= limit)

    def rerank(self, question: str, candidates: DataFrame) -> DataFrame:
        """The best candidates with their code, in order."""
        hits = self.engine.chunks(self.url).join(F.broadcast(candidates), ["filepath", "symbol", "start_line"])  # as many rows as candidates
        if not self.config.use_rerank:
            return hits.where(F.col("rank") <= self.config.top_k)
        passage = fusion.passage(F.col("symbol"), F.col("chunk_type"), F.col("filepath"), F.col("code_text"))
        return fusion.rerank(hits, fusion.word_overlap(question)(passage), self.config.top_k)

    def expand(self, hits: DataFrame, plan: Plan) -> DataFrame:
        """Chunks pulled in through the graph: named symbols, overrides, direct callees of the best three hits."""
        symbols, edges = self.engine.symbols(self.url), self.engine.edges(self.url)
        place = symbols.select("node", F.col("filepath"), F.col("qualified_name").alias("symbol"))
        names = [s.lower() for s in plan.symbols] or [""]
        lower = F.lower("symbol")
        named = place.where(lower.isin(names) | F.substring_index(lower, ".", -1).isin(names)).select(F.lit(0).alias("ord"), "filepath", "symbol")
        at = hits.select(F.concat("filepath", F.lit("\n"), "symbol").alias("hit"), "rank")
        methods = graph.of_type(edges, "HAS_METHOD").join(symbols.select(F.col("node").alias("dst"), "name"), "dst").select(F.col("dst").alias("node"), F.col("src").alias("owner"), "name")
        over = graph.overrides(methods, graph.of_type(edges, "INHERITS"))
        both = over.select(F.col("overridden").alias("hit"), F.col("method").alias("node")).unionByName(over.select(F.col("method").alias("hit"), F.col("overridden").alias("node")))
        overriding = both.join(at, "hit").join(place, "node").select(F.col("rank").alias("ord"), "filepath", "symbol")
        calls = graph.of_type(edges, "CALLS").select(F.col("src").alias("hit"), F.col("dst").alias("node"))
        callees = calls.join(at.where("rank <= 3"), "hit").join(place, "node").select(F.col("rank").alias("ord"), "filepath", "symbol")
        picked = fusion.expansion(named, overriding, callees, hits, self.config.expand)
        return self.engine.chunks(self.url).join(F.broadcast(picked), ["filepath", "symbol"])  # six rows at most

    def prompt(self, question: str, hits: DataFrame, expanded: DataFrame, history: list[dict]) -> str:
        """What a generator reads."""
        columns = ["filepath", "symbol", "chunk_type", "start_line", "end_line", "code_text"]
        every = hits.select(*columns, F.col("rank").alias("o")).unionByName(expanded.select(*columns, (F.col("priority") * 100 + F.col("ord")).alias("o")))
        shown = context.without_nested(every, self.config.snippet_lines).select("o", context.formatted(every, self.config.snippet_lines).alias("s"))
        snippets = [r.s for r in shown.orderBy("o", "s").collect()]  # at most top_k and expand rows
        turns = [f"{'User' if t.get('role') == 'user' else 'Assistant'}: {(t.get('content') or '').strip()}" for t in history[-context.HISTORY :]]
        return "\n\n".join([*turns, *snippets, f"Question: {question}"])

    def ask(self, question: str, history: list[dict] | None = None) -> Answer:
        """The whole run; without a generator, or if it fails, the answer lists what was found."""
        history, notes, followups = history or [], [], []
        plan = self.plan(question, history, notes)
        hits = self.rerank(question, self.retrieve(question, plan, notes))
        expanded = self.expand(hits, plan) if self.config.use_graph else self.engine.chunks(self.url).limit(0).withColumn("priority", F.lit(0)).withColumn("ord", F.lit(0))
        status, text = "degraded", None
        for round_ in range(self.config.followup_rounds + 1):
            try:
                text = self.generator(self.prompt(question, hits, expanded, history)) if self.generator else None
            except Exception as e:
                notes.append(f"generator: {e}")
                text = None
            wanted = self._requested(text)
            if wanted is None or round_ == self.config.followup_rounds:
                break
            followups.append(wanted)
            expanded = expanded.unionByName(self._fetched(wanted, hits, expanded), allowMissingColumns=True)
        if text is not None:
            status = "ok"
        else:
            lines = [r.line for r in context.degraded(hits).orderBy("rank").collect()]  # ten lines at most
            text = "\n".join(["No answer could be generated. This is the code that was found:", "", *lines])
        spans = context.snippet_spans(hits, self.config.snippet_lines).unionByName(context.snippet_spans(expanded, self.config.snippet_lines))
        cited = context.citations(self.engine.spark.createDataFrame([("answer", text)], "answer_id string, answer string"))
        return Answer(text, status, context.check(cited, spans), hits, expanded, followups, notes)

    def _requested(self, text: str | None) -> list[str] | None:
        if text is None:
            return None
        row = self.engine.spark.createDataFrame([(text,)], "r string").select(context.requested_items(F.col("r"), self.config.followup_items).alias("t")).first()
        return list(row.t) if row.t is not None else None

    def _fetched(self, items: list[str], hits: DataFrame, expanded: DataFrame) -> DataFrame:
        """Code that a generator asked for: by symbol, or by search if it looks like a path or is no symbol."""
        out = self.engine.chunks(self.url).limit(0)
        for item in items:
            found = self.engine.find(self.url, item).limit(self.config.chunks_an_item) if "/" not in item else None
            if found is None or not found.take(1):
                found = self.engine.search(self.url, item, self.config.chunks_an_item).withColumnRenamed("symbol", "qualified_name")
            key = found.select("filepath", F.col("qualified_name").alias("symbol"))
            out = out.unionByName(self.engine.chunks(self.url).join(F.broadcast(key), ["filepath", "symbol"], "left_semi"))
        seen = hits.select("filepath", "symbol").unionByName(expanded.select("filepath", "symbol"))
        return out.dropDuplicates(["filepath", "symbol"]).join(seen, ["filepath", "symbol"], "left_anti").withColumn("priority", F.lit(4)).withColumn("ord", F.lit(0))

    def stream(self, question: str, history: list[dict] | None = None) -> Iterator[dict]:
        """Events of a run: its steps, then the answer."""
        yield {"type": "step", "name": "retrieve"}
        answer = self.ask(question, history)
        yield {"type": "step", "name": "generate", "status": answer.status}
        yield {"type": "answer", "text": answer.text, "citations": [r.asDict() for r in answer.citations.orderBy("ord").collect()]}


def evaluate_retrieval(engine: Engine, url: str, cases: DataFrame, planner: Callable | None = None, variants: dict[str, Config] | None = None) -> DataFrame:
    """variant, stage, cases, recall, reciprocal_rank over labelled questions (bounded, run one by one)."""
    asked = [r for r in cases.where("answerable").collect()]
    gold = cases.select(F.col("id").alias("case_id"), F.explode("gold").alias("g")).select("case_id", "g.name", "g.filepath")
    out = None
    for name, config in (variants or VARIANTS).items():
        asker = Asker(engine, url, planner, config=config)
        for stage in ("candidates", "kept", "context"):
            rankings = None
            for case in asked:
                plan = asker.plan(case.question, [], [])
                rows = asker.retrieve(case.question, plan, [])
                if stage != "candidates":
                    rows = asker.rerank(case.question, rows)
                if stage == "context" and config.use_graph:
                    more = asker.expand(rows, plan).select("filepath", "symbol", (F.lit(config.top_k) + 1).alias("rank"))
                    rows = rows.select("filepath", "symbol", "rank").unionByName(more)
                one = rows.select(F.lit(case.id).alias("case_id"), "filepath", "symbol", "rank")
                rankings = one if rankings is None else rankings.unionByName(one)
            scored = evaluate.recall(evaluate.gold_hits(gold, rankings))
            row = evaluate.means(scored, ["recall", "reciprocal_rank"]).select(F.lit(name).alias("variant"), F.lit(stage).alias("stage"), "cases", "recall", "reciprocal_rank")
            out = row if out is None else out.unionByName(row)
    return out


def city(files: DataFrame) -> DataFrame:
    """filepath, lines, symbols, height, place: buildings in order of size on a square grid (files: filepath, lines, symbols)."""
    from pyspark.sql import Window as W

    from symgraph.operators.explore import height

    n = files.agg(F.ceil(F.sqrt(F.count("*")))).scalar()
    ranked = files.withColumn("place", F.row_number().over(W.partitionBy(F.substring_index("filepath", "/", 1)).orderBy(F.desc("lines"), "filepath")) - 1)
    return ranked.select("filepath", "lines", "symbols", F.round(height(F.col("lines")), 6).alias("height"), (F.col("place") % n).alias("x"), F.floor(F.col("place") / n).alias("y"))


__all__ = ["Answer", "Asker", "Config", "Plan", "RecordedPlanner", "VARIANTS", "city", "evaluate_retrieval"]
