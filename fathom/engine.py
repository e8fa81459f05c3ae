"""The facade: named indexes, searched with JSON documents or query strings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators import aggregate, feedback, order, store
from .operators.table import Table
from .plans.compiler import Compiler, Node, Schema, compile_query, corpus, tokenised

#: script(documents with _old_doc, method, **params) -> documents
Script = Callable[..., DataFrame]
OLD_DOC = "_old_doc"


class Index:
    """A document DataFrame with its search options."""

    def __init__(self, frame: DataFrame, id_field: str = "_id", **options: object):
        self.schema = Schema(frame, id_field=id_field, **options)

    @property
    def frame(self) -> DataFrame:
        return self.schema.frame

    def compiled(self, query: object) -> Node:
        if isinstance(query, list):  # several q= parameters
            return Compiler(self.schema).combine("_and", [compile_query(self.schema, q) for q in query])
        return compile_query(self.schema, "*" if query is None else query)

    def matching(self, query: object) -> DataFrame:
        return self.frame.where(F.coalesce(self.compiled(query).match, F.lit(False)))

    def count(self, query: object = "*") -> int:
        """Exact, where an index would estimate."""
        return self.matching(query).count()

    def get(self, key: object, selector: str | None = None) -> DataFrame:
        """A document, or the fields of a selector such as "{a,b{c}}" or "b.c"."""
        found = self.frame.where(F.col(self.schema.id_field) == F.lit(key))
        return order.select(found, selector) if selector else found

    def blob(self, key: object, content_type: str, field: str = "_blobs") -> DataFrame:
        """data of a document's blob of that type; blobs are array<struct<content_type, data>>."""
        blobs = self.get(key).select(F.explode(field).alias("b"))
        return blobs.where(F.col("b.content_type") == content_type).select(F.col("b.data").alias("data"))

    def describe(self, key: object) -> DataFrame:
        """What is indexed of a document: kind ("term" or "value"), field, value as text, and wdf of terms.

        Terms are the words of text fields and the values of the others, in lower case unless
        the field is compared with case; values are each field's distinct ones.
        """
        row, rows = self.get(key), []
        for name in self.frame.columns:
            f = self.schema.find(name)
            if isinstance(f.element, T.StructType | T.MapType | T.VariantType):
                continue
            each = row.select(F.explode(F.array_distinct(f.column) if f.array else F.array(f.column)).alias("v")).where("v is not null")
            text = F.col("v").cast("string")
            if f.text:
                words = row.select(F.explode(Compiler(self.schema).tokens(f)).alias("value")).groupBy("value").agg((F.count("*") * self.schema.weights.get(name, 1)).cast("double").alias("wdf"))
                rows.append(words.select(F.lit("term").alias("kind"), F.lit(name).alias("field"), "value", "wdf"))
            else:
                folded = F.lower(text) if isinstance(f.element, T.StringType) and not f.bool_term else text
                rows.append(each.select(F.lit("term").alias("kind"), F.lit(name).alias("field"), folded.alias("value"), F.lit(0.0 if f.bool_term else 1.0).alias("wdf")))
            rows.append(each.select(F.lit("value").alias("kind"), F.lit(name).alias("field"), text.alias("value"), F.lit(None).cast("double").alias("wdf")))
        return reduce(DataFrame.union, rows)

    def exists(self, key: object) -> bool:
        return not self.get(key).isEmpty()

    def scored(self, query: object) -> DataFrame:
        """Matching documents with their _weight."""
        node = self.compiled(query)
        return self._weighed(node)

    def _weighed(self, node: Node) -> DataFrame:
        stats = corpus(self.schema, node.terms)
        hits = tokenised(self.schema, self.frame.where(F.coalesce(node.match, F.lit(False))), node.terms)
        return hits.select(*[F.col(f"`{c}`") for c in self.frame.columns], node.weight(stats).cast("double").alias("_weight"))

    def search(self, query: object = "*", sort: object = None, offset: int = 0, limit: int = 10, collapse: str | None = None, collapse_max: int = 1, selector: str | None = None, metric: str | None = None, ranked: bool = False) -> DataFrame:
        """A page of hits; by relevance where there is no sort. ranked adds _weight, _rank and _percent."""
        body = query if isinstance(query, dict) and "_query" in query else {}
        query = body.get("_query", query)
        sort, offset, limit = body.get("_sort", sort), body.get("_offset", offset), body.get("_limit", limit)
        selector = body.get("_selector", selector)
        last = F.col(self.schema.id_field).asc()
        if sort is None or ranked:
            hits = self.scored(query)
            keys: list[Column] = [] if sort is None else order.sort_keys(self.schema, sort, metric)
            keys += [F.col("_weight").desc(), last]
        else:
            hits, keys = self.matching(query), [*order.sort_keys(self.schema, sort, metric), last]
        if collapse:
            hits = order.collapse(hits, self.schema.find(collapse).column, keys, collapse_max)
        out = order.page(hits, keys, offset, limit)
        if ranked:  # over one page
            rank = Window.orderBy(*keys)
            out = out.withColumn("_rank", F.row_number().over(rank) - 1 + offset).withColumn("_percent", F.when(F.max("_weight").over(Window.partitionBy()) > 0, 100 * F.col("_weight") / F.max("_weight").over(Window.partitionBy())).otherwise(100.0))
        elif "_weight" in out.columns:
            out = out.drop("_weight")
        return order.select(out, selector) if selector else out

    def aggregations(self, aggs: dict, query: object = "*") -> dict[str, DataFrame]:
        """A DataFrame for each aggregation, by its path in the tree."""
        return aggregate.Aggregator(self.schema, self.matching(query)).frames(aggregate.plan(aggs))

    def aggregate(self, aggs: dict, query: object = "*") -> dict:
        """The rendered tree."""
        nodes = aggregate.plan(aggs)
        return aggregate.render(nodes, aggregate.Aggregator(self.schema, self.matching(query)).frames(nodes))

    def like(self, query: object, text_field: str | list[str], keep: bool = False, n_rset: int = feedback.N_RSET, n_eset: int = feedback.N_ESET, n_term: int = feedback.N_TERM, limit: int = 10) -> DataFrame:
        """Documents like the best n_rset hits, by words of the text fields, with _weight; keep also matches the query itself."""
        top = self.search(query, limit=n_rset).select(self.schema.id_field)
        ids = [r[0] for r in top.collect()]
        fields = [self.schema.find(f) for f in ([text_field] if isinstance(text_field, str) else text_field)]
        node = feedback.expanded(self.schema, fields, ids, self.schema.id_field, n_eset, n_term)
        if keep:
            node = Compiler(self.schema).combine("_or", [self.compiled(query), node])
        hits = self._weighed(node)
        return order.page(hits, [F.col("_weight").desc(), F.col(self.schema.id_field).asc()], 0, limit)

    def info(self, text_field: str | None = None) -> DataFrame:
        """Document count, greatest id and, of a text field, its lengths in words."""
        cols = [F.count("*").alias("doc_count"), F.max(self.schema.id_field).alias("last_id")]
        if text_field:
            size = F.size(Compiler(self.schema).tokens(self.schema.find(text_field)))
            cols += [F.avg(size).alias("av_length"), F.min(size).alias("doc_len_lower"), F.max(size).alias("doc_len_upper")]
        return self.frame.agg(*cols)

    def with_frame(self, frame: DataFrame) -> Index:
        out = object.__new__(Index)
        out.schema = replace(self.schema, frame=frame)
        return out

    def put(self, new: DataFrame) -> Index:
        return self.with_frame(store.put(self.frame, new, self.schema.id_field))

    def update(self, new: DataFrame) -> Index:
        return self.with_frame(store.update(self.frame, new, self.schema.id_field))

    def upsert(self, new: DataFrame) -> Index:
        return self.with_frame(store.upsert(self.frame, new, self.schema.id_field))

    def delete(self, keys: DataFrame) -> Index:
        return self.with_frame(store.delete(self.frame, keys, self.schema.id_field))

    def write(self, new: DataFrame, method: str = "put", script: Script | None = None, **params: object) -> Index:
        """put, update or upsert, after a script that makes the documents to write.

        The script gets the new documents with the column _old_doc, a struct of the stored
        document or null, the method's name and the parameters. Rows that it leaves out aren't
        written.
        """
        if script:
            key = self.schema.id_field
            old = self.frame.select(F.col(key), F.struct(*[F.col(f"`{c}`") for c in self.frame.columns]).alias(OLD_DOC))
            new = script(store.single(new, key).join(old, key, "left"), method, **params).drop(OLD_DOC)
        return {"put": self.put, "update": self.update, "upsert": self.upsert}[method](new)

    def commit(self, path: str, batch: int = 0) -> Index:
        """Writes the documents as a state of the table at `path` (see operators.table) and reads them from it."""
        table = Table(self.frame.sparkSession, path, self.schema.id_field)
        gone = None if not table.numbers() else table.read().join(self.frame.select(self.schema.id_field), self.schema.id_field, "left_anti")
        changed = self.frame if gone is None else self.frame.unionByName(gone, allowMissingColumns=True)
        kept = self.frame
        table.change(changed, lambda _, __: kept, batch)
        return self.with_frame(table.read())

    def patch(self, ops: list[dict], query: object = "*") -> Index:
        hit = F.coalesce(self.compiled(query).match, F.lit(False))
        changed = store.patch(self.frame.where(hit), ops)
        return self.with_frame(self.frame.where(~hit).unionByName(changed, allowMissingColumns=True))


class Engine:
    """Named indexes; a comma list of names searches their union. Metadata and scripts by name."""

    def __init__(self) -> None:
        self.indexes: dict[str, Index] = {}
        self.metadata: dict[str, dict] = {}
        self.scripts: dict[str, object] = {}

    def create(self, name: str, frame: DataFrame, **options: object) -> Index:
        self.indexes[name] = Index(frame, **options)
        return self.indexes[name]

    def index(self, names: str) -> Index:
        found = [self.indexes[n.strip().strip("/")] for n in names.split(",")]
        return found[0] if len(found) == 1 else found[0].with_frame(store.union_indexes(*[i.frame for i in found]))

    def script(self, name: str, transform: Callable) -> None:
        """Registers a transform of DataFrames, for run() or write()."""
        self.scripts[name] = transform

    def run(self, script: str, index: str, **params: object) -> Index:
        """Applies script(documents, **params) to all documents of an index."""
        at = self.indexes[index]
        self.indexes[index] = at.with_frame(self.scripts[script](at.frame, **params))
        return self.indexes[index]

    def write(self, index: str, new: DataFrame, method: str = "put", script: str | None = None, **params: object) -> Index:
        """Writes documents, through a registered script if one is named; see Index.write."""
        self.indexes[index] = self.indexes[index].write(new, method, self.scripts[script] if script else None, **params)
        return self.indexes[index]

    def settings(self, index: str, **options: object) -> Index:
        """Changes search options of an index: text fields, stemming, weights and others of Schema."""
        at = self.indexes[index]
        at.schema = replace(at.schema, **options)
        return at

    def described(self, index: str) -> dict:
        """An index's settings and the types of its fields."""
        schema = self.indexes[index].schema
        options = {k: getattr(schema, k) for k in ("text", "bool_terms", "id_field", "stop_language", "stop_words", "stem", "cjk", "weights", "open_ranges")}
        return {"settings": options | {"points": sorted(schema.points)}, "schema": {f.name: f.dataType.simpleString() for f in schema.frame.schema.fields}}
