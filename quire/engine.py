"""One object for what a user does: import, compile, search, inspect, ask."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.jsonvals import endpoint_scope
from quire.functions.text import stable_id, text_hash
from quire.operators import blocks, pack, postings, relations, replay, revindex, search, segment
from quire.plans import book, checking, extraction, packet, planner, verify
from quire.plans import compile as layers
from quire.plans import roles as role_layer
from quire.sources import importer
from quire.sources.audit import Audit, Recorder
from quire.sources.provider import Provider
from quire.sources.settings import Settings
from quire.sources.store import Store

#: What full-text search looks at: table, its key and text columns, and the most hits.
SEARCHED = {
    "paragraphs": ("id", ["text"], 20), "scene_cards": ("scene_id", ["title", "summary"], 10), "summaries": ("record_id", ["summary", "themes", "unresolved"], 5),
    "entities": ("id", ["canonical_name", "aliases", "type"], 10),
}


class InsufficientEvidence(ValueError):
    """Nothing was found that an answer could rest on."""


@dataclass
class Answer:
    """An answer, the paragraphs it cites and the records it was made from."""

    intent: str
    text: str
    evidence: list[str]
    records_used: list[str]
    raw: dict = field(default_factory=dict)


class Engine:
    """Relations of one manuscript in a folder, and the operations on them."""

    def __init__(self, spark: SparkSession, root: str, settings: Settings | None = None):
        self.spark, self.store, self.settings = spark, Store(spark, root), settings or Settings()

    # --- import -----------------------------------------------------------

    def import_files(self, files: DataFrame, manifest: importer.Manifest | None = None, replace: bool = False) -> list[str]:
        """Chapters, blocks and paragraphs from source files; warnings."""
        if self.store.generation() is not None and not replace:
            raise FileExistsError("there is a manuscript already; replace it explicitly")
        chapters, warnings = importer.plan_folder(files, manifest)
        self._store(chapters, warnings)
        return warnings

    def import_document(self, docs: DataFrame, name: str, level: int = 1, regex: str | None = None, single: bool = False, replace: bool = False) -> list[str]:
        """Chapters from one continuous document, a row (id, text) named ``name``."""
        if self.store.generation() is not None and not replace:
            raise FileExistsError("there is a manuscript already; replace it explicitly")
        chapters, warnings = importer.plan_file(docs, name, level, regex, single)
        self._store(chapters, warnings, name)
        return warnings

    def _store(self, chapters: DataFrame, warnings: list[str], source: str = "") -> None:
        found = blocks.parse_blocks(chapters.select(F.col("id").alias("chapter_id"), F.col("content").alias("text")), "chapter_id", markers=self.settings.scene_breaks)
        own = F.when(blocks.citable(F.col("block_type")), stable_id("p", F.col("chapter_id"), F.col("ordinal")))
        b = found.withColumn("paragraph_id", own)
        p = blocks.paragraphs(found, "chapter_id").select(
            "id", "chapter_id", "ordinal", "block_ordinal", "block_type", "text", text_hash(F.col("text")).alias("text_hash"),
            F.col("line_start").alias("source_line_start"), F.col("line_end").alias("source_line_end"),
        )
        kept = {n: self.store.read(n) for n in ("imports", "runs", "tasks") if self.store.has(n)}
        self.store.rebuild({"chapters": chapters.drop("content"), "blocks": b, "paragraphs": p} | kept)
        record = importer.import_record(self.store.read("chapters"), self.store.read("paragraphs"), source, warnings)
        self.store.append({"imports": record})
        self._index("paragraphs")

    def _keep(self, **fresh: DataFrame) -> None:
        """New versions of some tables and, where they are searched, of their indexes."""
        self.store.update(fresh)
        for name in fresh:
            if name in SEARCHED:
                self._index(name)

    def _index(self, name: str) -> None:
        """Postings and statistics of one table's texts."""
        key, cols, _ = SEARCHED[name]
        rows = self._searchable(name)
        buckets = postings.buckets_for(rows, cols)
        self.store.update({f"fts_{name}": postings.build(rows, [key], cols, buckets)})
        self.store.update({f"fts_{name}_stats": postings.statistics(rows, self.store.read(f"fts_{name}"), buckets)})

    def _searchable(self, name: str) -> DataFrame:
        rows = self.store.read(name)
        listed = [f.name for f in rows.schema.fields if f.dataType.simpleString() == "array<string>"]
        return rows.withColumns({c: F.array_join(c, " ") for c in SEARCHED[name][1] if c in listed})

    # --- compile ----------------------------------------------------------

    def compile_scenes(self, proposed: DataFrame | None = None) -> None:
        s = self.settings
        breaks = self.store.read("blocks").where("block_type = 'scene_break'").select("chapter_id", "ordinal")
        scenes = segment.detect(self.store.read("paragraphs"), breaks, proposed, s.scene_mode, s.scene_target, s.scene_max_paragraphs)
        bad = segment.partition_violations(scenes, self.store.read("paragraphs"))
        replay.require(bad, "scenes")
        self._keep(scenes=scenes)

    def compile_cards(self, provider: Provider, model: str = "") -> None:
        cards = layers.scene_cards(self.store.read("scenes"), self.store.read("paragraphs"), provider, model)
        self._keep(scene_cards=cards)
        self.rebuild_index()

    def rebuild_index(self) -> None:
        self._keep(index_refs=revindex.refs(self.store.read("scene_cards")))
        self._keep(index_terms=revindex.terms(self.store.read("index_refs"), distinct=True))

    def compile_entities(self, provider: Provider, model: str = "", force: bool = False) -> None:
        """Entities and occurrences of chapters without a snapshot (all, if forced)."""
        scenes, refs = self.store.read("scenes"), self.store.read("index_refs")
        if self.store.has("entity_snapshots") and not force:
            scenes = replay.pending(scenes, self.store.read("entity_snapshots"), ["chapter_id"])
            refs = refs.join(scenes.select("chapter_id").distinct(), "chapter_id", "left_semi")
        entities, occurrences, snapshots = extraction.compile_entities(refs, scenes, provider, model)
        fresh = {"entities": entities, "occurrences": occurrences, "entity_snapshots": snapshots}
        if self.store.has("entities"):
            done = snapshots.select("chapter_id")
            fresh["entities"], fresh["occurrences"] = relations.replace_chapters(self.store.read("entities"), self.store.read("occurrences"), entities, occurrences, done)
            fresh["entity_snapshots"] = pack.replace_group(self.store.read("entity_snapshots"), snapshots, "chapter_id")
        self._keep(**fresh)

    def delete_scenes(self, gone: DataFrame) -> None:
        """Scenes (scene_id) with all that hangs on them; the reverse index is to be rebuilt after."""
        names = [n for n in ("scenes", "scene_cards", "occurrences", "entities", "index_refs", "index_terms") if self.store.has(n)]
        self._keep(**relations.without_scenes({n: self.store.read(n) for n in names}, gone))

    def compile_roles(self, provider: Provider, model: str = "", prompt_version: str = "roles-v1", force: bool = False) -> bool:
        """Roles of the whole book; whether anything was asked."""
        entities, occurrences, cards = (self.store.read(n) for n in ("entities", "occurrences", "scene_cards"))
        missing = replay.pending(self.store.read("chapters").select(F.col("id").alias("chapter_id")), self.store.read("entity_snapshots"), ["chapter_id"])
        if not missing.isEmpty():
            raise role_layer.RoleError("roles need the entities of every chapter")
        found = role_layer.sources(entities, occurrences)
        hashed = role_layer.input_hash(found, role_layer.context(found, cards))
        if not force and role_layer.is_current(self.store.note("roles"), hashed, model, prompt_version):
            return False
        before = self.store.read("roles") if self.store.has("roles") else None
        roles, snapshot = role_layer.compile_roles(entities, occurrences, cards, provider, model, before)
        self.store.update({"roles": roles}, roles=snapshot | {"prompt_version": prompt_version})
        return True

    def compile_book(self, provider: Provider, model: str = "") -> None:
        """The book's summary beside those of its chapters."""
        s = self.store.read("summaries").where("record_type = 'chapter_summary'")
        chapters = s.join(self.store.read("chapters").select(F.col("id").alias("chapter_id"), "ordinal"), "chapter_id").select("chapter_id", "ordinal", "summary")
        roles = self.store.read("roles") if self.store.has("roles") else self.spark.createDataFrame([], "character_id string, canonical_name string, classification string")
        done = book.compile_book(chapters, roles, provider, model, (self.store.note("roles") or {}).get("artifact_hash", ""))
        self._keep(summaries=s.unionByName(done, allowMissingColumns=True))

    def compile_verification(self, provider: Provider, mode: str | None = None, model: str = "", force: bool = False) -> None:
        """Cards checked by a second model, with the status that follows."""
        how = verify.effective_mode(mode, self.settings.verification)
        cards = checking.check_cards(self.store.read("scene_cards"), self.store.read("paragraphs"), provider, how, self.settings.auto_accept, model, force)
        self._keep(scene_cards=cards)

    def compile_summaries(self, provider: Provider, model: str = "") -> None:
        p = self.store.read("paragraphs")
        windows = segment.token_windows(p, self.settings.window_tokens, self.settings.window_overlap)
        done = layers.chapter_summaries(windows, p, provider, model)
        names = self.store.read("chapters").select(F.col("id").alias("chapter_id"), F.col("title").alias("chapter_title"))
        out = done.join(names, "chapter_id").select(
            F.concat(F.lit("chapter_summary:"), "chapter_id").alias("record_id"), F.lit("chapter_summary").alias("record_type"), "*", F.lit("generated").alias("status")
        )
        self._keep(summaries=out)

    def cards_to_verify(self, mode: str | None = None) -> DataFrame:
        """Cards that a mode selects and no verdict covers."""
        return checking.selected(self.store.read("scene_cards"), verify.effective_mode(mode, self.settings.verification))

    # --- questions --------------------------------------------------------

    def status(self) -> dict[str, int]:
        names = ("chapters", "paragraphs", "scenes", "scene_cards", "summaries", "entities", "occurrences", "roles", "index_terms")
        return {n: self.store.read(n).count() if self.store.has(n) else 0 for n in names}

    def inspect(self, table: str, value: str, column: str = "id") -> DataFrame:
        return relations.by_id(self.store.read(table), value, column)

    def search(self, query: str, chapter: str | None = None, most: int = SEARCHED["paragraphs"][2]) -> dict[str, DataFrame]:
        """Best rows of paragraphs, cards, summaries and entities, each under its own limit."""
        out = {}
        for name, (key, _, limit) in SEARCHED.items():
            if not self.store.has(f"fts_{name}"):
                continue
            rows = self.store.read(name)
            let = rows.where(F.col("chapter_id") == chapter) if chapter else None
            if name == "scene_cards":
                let = relations.with_status(rows if let is None else let, self.settings.card_policy)
            index, stats = self.store.read(f"fts_{name}"), self.store.read(f"fts_{name}_stats")
            hits = postings.search(index, stats, query, [key], let, most if name == "paragraphs" else limit)
            out[name] = hits.join(rows, key).orderBy("score", key)
        return out

    def ranked(self, query: str, chapter: str | None = None) -> DataFrame:
        """(source, rank, id, score): one listing of all hits."""
        return search.search_sources({n: (hits.select(SEARCHED[n][0], "score"), SEARCHED[n][0], SEARCHED[n][2]) for n, hits in self.search(query, chapter).items()})

    def _cards(self, chapter: str) -> DataFrame:
        return relations.cards_in_order(self.store.read("scene_cards"), self.store.read("scenes"), self.store.read("chapters"), self.settings.card_policy, chapter or None)

    def packet(self, question: str, mode: str = "recall", chapter: str = "", provider: Provider | None = None, model: str = "") -> packet.Packet:
        """All that an answer may rest on, and what it was made of."""
        most = self.settings.max_evidence
        kind, wide = self.spark.range(1).select(
            planner.intent(F.lit(question), F.lit(mode), F.lit(chapter)).alias("i")
        ).select("i", planner.paragraph_limit(F.col("i"), F.lit(most))).first()
        hits = self.search(question, chapter or None, wide)
        p = self.store.read("paragraphs")
        p = p.where(F.col("chapter_id") == chapter) if chapter else p
        found = hits["paragraphs"].select("id", "chapter_id", "text", F.col("score").alias("o"))
        cards, by_score = hits.get("scene_cards"), [F.col("score"), F.col("scene_id")]
        if cards is not None and found.isEmpty() and cards.isEmpty():
            cards = planner.fallback_cards(self._cards(chapter), kind).withColumn("score", F.col("chapter_ordinal") * 10.0**6 + F.col("scene_ordinal"))
        summaries = planner.summaries_for(self.store.read("summaries"), kind, chapter) if self.store.has("summaries") else None
        has_summaries = summaries is not None and not summaries.isEmpty()

        # paragraphs: what summaries cite comes first, but for the ending, where it comes last
        parts = [found]
        if cards is not None:
            cited = relations.evidence_rows(cards.select("scene_id", "evidence", "score"), p)
            order = cards.select("scene_id", F.dense_rank().over(Window.orderBy(*by_score)).alias("_card"))
            parts.append(cited.join(order, "scene_id").select("id", "chapter_id", "text", (F.col("_card") * 10.0**6 + F.col("position")).alias("o")))
        if has_summaries:
            refs = relations.unresolved_summary_refs(self.store.read("summaries"))
            refs = refs.join(summaries.select("record_id"), "record_id", "left_semi").groupBy("id").agg(F.min(F.struct("record_id", "position", "inner")).alias("r"))
            rank = F.row_number().over(Window.orderBy("r", "id"))  # the evidence of a few summaries
            parts.insert(len(parts) if kind == "ending" else 0, refs.join(p, "id").select("id", "chapter_id", "text", rank.cast("double").alias("o")))
        rows = pack.ordered_union(parts, "id", "o")
        fallback = rows.isEmpty()
        if fallback:
            c = self.store.read("chapters").select(F.col("id").alias("chapter_id"), F.col("ordinal").alias("_c"))
            rows = p.join(c, "chapter_id").select("id", "chapter_id", "text", (F.col("_c") * 10.0**6 + F.col("ordinal")).alias("o"), F.lit(0).alias("source_rank"))
        # at most the limits of the searches, or one manuscript's paragraphs
        placed = rows.withColumn("position", F.row_number().over(Window.orderBy("source_rank", "o", "id"))).withColumn("_q", F.lit(1))

        if cards is not None and planner.wants_coverage_cards(kind, has_summaries, not cards.isEmpty()):
            more = planner.coverage_cards(self._cards(chapter), kind).withColumn("score", 10.0**9 + F.col("chapter_ordinal") * 10.0**6 + F.col("scene_ordinal"))
            columns = ["scene_id", "chapter_id", "title", "summary", "score"]
            cards = pack.ordered_union([cards.select(columns), more.select(columns)], "scene_id", "score")
            by_score = [F.col("source_rank"), F.col("score"), F.col("scene_id")]
        has_cards = cards is not None and not cards.isEmpty()
        sections = [summaries] if has_summaries else []
        sections = [packet.summary_rows(s) for s in sections]
        entities = None
        if self.store.has("entities"):
            matched = [r["id"] for r in hits["entities"].select("id").collect()] if "entities" in hits else []
            every = relations.entities_in_order(self.store.read("entities"), chapter or None)
            entities = planner.top_entities(every, question, mode, kind, matched)
            if self.store.has("roles"):
                sections.append(packet.role_rows(planner.top_roles(self.store.read("roles"), entities, question, mode, kind)))
            sections.append(packet.entity_rows(entities))
        n = placed.count()
        if provider is not None and packet.wants_digests(kind, n, most, has_summaries, has_cards):
            made = packet.digests(placed, ["_q"], most, provider, model)
            made = self.spark.createDataFrame(made.collect(), made.schema)  # a few rows, asked for once
            if not made.where("summary = ''").isEmpty():
                raise ValueError("a digest has no summary")
            sections.append(packet.rows_of(made, "digest", F.col("digest_id"), F.col("summary"), [F.col("digest_id")], sources=F.col("support")))
        if has_cards:
            sections.append(packet.card_rows(cards, by_score))
        packed = planner.pack_paragraphs(placed, ["_q"], most, F.lit(kind), F.lit(fallback))
        sections.append(packet.rows_of(packed, "paragraph", F.col("id"), F.col("text"), [F.col("position")], F.col("chapter_id")))
        out = packet.Packet(kind)
        for part in sections:
            for r in part.orderBy("position").collect():
                row = r.asDict()
                out.sources[row["record_id"]] = row.pop("sources")
                out.rows.append(row)
        return out

    def ask(self, question: str, provider: Provider, mode: str = "recall", chapter: str = "", model: str = "") -> Answer:
        """An answer whose citations and records are all in the packet it was given; the call is kept."""
        audit = Audit(self.store)
        with audit.run("query") as run_id:
            recorder = Recorder(provider, run_id)
            given = self.packet(question, mode, chapter, provider, model)
            if given.is_empty():
                raise InsufficientEvidence("no paragraph, card or summary bears on the question")
            text, cited, used, raw = packet.answered(given, question, recorder, mode, model)
            audit.calls(recorder)
        return Answer(given.intent, text, cited, used, raw)

    @staticmethod
    def endpoint(url: str) -> str:
        return endpoint_scope(url)
