"""Names in texts: all aliases of a gazetteer in one pass by a trie over words, and the entities that they name."""

from __future__ import annotations

import pickle
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from millrace.storage import BROADCAST_BYTES

ENTITY_SCHEMA = "article_id long, kind string, name string, make string, model string, chassis string, in_title boolean, confidence int"
#: How sure one is of each way to find an entity.
CONFIDENCE = {"model": 86, "model_by_generation": 82, "generation": 90, "variant": 80, "make": 92, "implied_make": 80}

_GAP = re.compile(r"[\s-]+")
#: What texts are made of: runs of ASCII letters and digits, and other characters one by one.
_ATOM = re.compile(r"[a-z0-9]+|.", re.S)


def folded(text: str | None) -> str:
    return (text or "").lower().replace("’", "'")


def atoms(text: str) -> list[str]:
    """Of a folded text; blanks and hyphens between words count as one blank."""
    return _ATOM.findall(_GAP.sub(" ", text))


class AliasTrie:
    """Finds which aliases occur as whole words: parts joined by blanks or hyphens; digits alone may take a plural s.

    The aliases' atoms form a trie in which every node knows the longest proper end of its way that begins another way,
    so a text is read once, whatever the number of aliases. Nodes are dictionaries from atoms to nodes.
    """

    def __init__(self, aliases: Iterable[str]):
        self.aliases = sorted(set(aliases))
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[list[tuple[int, int, bool, bool]]] = [[]]  # alias, atoms, must a run of letters not stand before, after
        for number, alias in enumerate(self.aliases):
            way = atoms(_GAP.sub(" ", folded(alias)).strip(" "))
            for one in [way, atoms(folded(alias) + "s")] if alias.isdigit() else [way]:
                if one:
                    self._add(number, one)
        self.back = self._links()

    def _add(self, number: int, way: list[str]) -> None:
        at = 0
        for atom in way:
            if atom not in self.next[at]:
                self.next[at][atom] = len(self.next)
                self.next.append({})
                self.ends.append([])
            at = self.next[at][atom]
        self.ends[at].append((number, len(way), not _run(way[0]), not _run(way[-1])))

    def _links(self) -> list[int]:
        back, left = [0] * len(self.next), [*self.next[0].values()]
        for node in left:  # by depth, as it grows
            for atom, below in self.next[node].items():
                link = back[node]
                while link and atom not in self.next[link]:
                    link = back[link]
                back[below] = self.next[link].get(atom, 0)
                self.ends[below] = self.ends[below] + self.ends[back[below]]
                left.append(below)
        return back

    def find(self, text: str) -> set[int]:
        """The numbers of the aliases that a folded text holds."""
        found: set[int] = set()
        follow, ends, back, at = self.next, self.ends, self.back, 0
        first = follow[0]
        words = atoms(text)
        for i, atom in enumerate(words):
            if not at:
                at = first.get(atom, 0)
            else:
                while at and atom not in follow[at]:
                    at = back[at]
                at = follow[at].get(atom, 0)
            if at and ends[at]:
                for number, n, free_before, free_after in ends[at]:
                    if number not in found and not (free_before and i >= n and _run(words[i - n])) and not (free_after and i + 1 < len(words) and _run(words[i + 1])):
                        found.add(number)
        return found


def needle(alias: str) -> str:
    """The alias as a pattern of folded text, without what must stand around it."""
    parts = [re.escape(p) for p in _GAP.split(folded(alias)) if p]
    return r"[\s-]+".join(parts) + ("s?" if alias.isdigit() else "")


def _run(atom: str) -> bool:
    return atom[0] in "abcdefghijklmnopqrstuvwxyz0123456789"


def _pieces(rows: list, limit: int) -> list[list]:
    """Rows in lists of at most so many bytes as they travel, each of one row at least."""
    out: list[list] = []
    size = limit + 1
    for row in rows:
        own = len(pickle.dumps(row))
        if size + own > limit:
            out.append([])
            size = 0
        out[-1].append(row)
        size += own
    return out


#: Bytes of a trie in memory for each byte of its rules, about.
SPREAD = 8


def find_aliases(rows: DataFrame, texts: dict[str, Column], aliases: Iterable[str], limit: int = BROADCAST_BYTES) -> DataFrame:
    """rows and, for each name of texts, an array of the aliases that the text holds, in their order; null texts hold none.

    The trie goes to every executor once, as a broadcast of at most about limit bytes; more aliases go one list after the other.
    """
    aliases = list(dict.fromkeys(aliases))
    out = rows.withColumns({f"__{name}": F.coalesce(text, F.lit("")) for name, text in texts.items()})
    none = F.array().cast("array<string>")
    out = out.withColumns({name: none for name in texts})
    for piece in _pieces(aliases, max(1, limit // SPREAD)):
        shared = rows.sparkSession.sparkContext.broadcast(AliasTrie(piece))
        out = _with_found(out, list(texts), shared)
    return out.drop(*[f"__{name}" for name in texts])


def _with_found(rows: DataFrame, names: list[str], shared) -> DataFrame:
    fields = [f if f.name not in names else StructField(f.name, ArrayType(StringType())) for f in rows.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shared.value
        for batch in batches:
            for name in names:
                texts, before = batch.column(batch.schema.names.index(f"__{name}")), batch.column(batch.schema.names.index(name))
                found = [[*old, *(trie.aliases[n] for n in sorted(trie.find(folded(text))))] for text, old in zip(texts.to_pylist(), before.to_pylist(), strict=True)]
                batch = batch.set_column(batch.schema.names.index(name), name, pa.array(found, pa.list_(pa.string())))
            yield batch

    return rows.mapInArrow(run, StructType(fields))


# -- entities ---------------------------------------------------------------------------------------------------------
class Gazetteer:
    """Makes, with aliases and models; models with aliases, generations, variants and whether a generation implies them.

    rows: dictionaries make, make_aliases, models (name, aliases, generations, variants, generation_implies_model).
    special: further variants of one model, as rules (model, name, needles, confidence); they hold only with that model.
    Only makes and models of which an alias was found are looked at.
    """

    def __init__(self, rows: list[dict], special: list[dict] = ()):
        self.rows, self.special = rows, defaultdict(list)
        for rule in special:
            self.special[rule["model"]].append(rule)
        names = {a for r in rows for a in (r["make"], *r["make_aliases"])} | {a for r in rows for m in r["models"] for a in (m["name"], *m["aliases"], *m["generations"], *m["variants"])}
        self.trie = AliasTrie(names | {n for rule in special for n in rule["needles"]})
        number = {a: n for n, a in enumerate(self.trie.aliases)}
        self.names: dict[int, str] = dict(enumerate(self.trie.aliases))
        self.users: dict[int, list[tuple[int, int]]] = defaultdict(list)  # of an alias: make and model, -1 for the make itself
        for r, row in enumerate(rows):
            for a in {row["make"], *row["make_aliases"]}:
                self.users[number[a]].append((r, -1))
            for m, model in enumerate(row["models"]):
                for a in {model["name"], *model["aliases"], *model["generations"]}:
                    self.users[number[a]].append((r, m))

    def entities(self, title: str | None, body: str | None) -> list[tuple]:
        """(kind, name, make, model, chassis, in_title, confidence), in the order of the gazetteer."""
        head = folded(title)
        text = {self.names[n]: n for n in self.trie.find(f"{head} {folded(body)}")}
        if not text:
            return []
        top = {self.names[n] for n in self.trie.find(head)}
        touched: dict[int, set[int]] = defaultdict(set)
        for n in text.values():
            for r, m in self.users.get(n, ()):
                touched[r].add(m)
        has, led = lambda names: any(n in text for n in names), lambda names: any(n in top for n in names)
        found: list[tuple] = []
        for r in sorted(touched):
            row = self.rows[r]
            make, aliases = row["make"], [row["make"], *row["make_aliases"]]
            direct, models = -1 in touched[r], []
            for m in sorted(touched[r] - {-1}):
                model = row["models"][m]
                names = [model["name"], *model["aliases"]]
                by_name = has(names)
                generations = [g for g in model["generations"] if g in text]
                if not by_name and not model["generation_implies_model"]:
                    continue
                if by_name and not direct and not model["generation_implies_model"] and not generations:
                    continue
                models.append(("model", model["name"], make, model["name"], generations[0] if generations else None, led([*names, *generations]), CONFIDENCE["model" if by_name else "model_by_generation"]))
                models += [("generation", g, make, model["name"], g, g in top, CONFIDENCE["generation"]) for g in generations]
                models += [("variant", v, make, model["name"], None, v in top, CONFIDENCE["variant"]) for v in model["variants"] if v in text]
                for rule in self.special.get(model["name"], ()):
                    if rule["name"] not in model["variants"] and has(rule["needles"]):
                        models.append(("variant", rule["name"], make, model["name"], None, led(rule["needles"]), rule["confidence"]))
            if direct or models:
                found.append(("make", make, make, None, None, led(aliases), CONFIDENCE["make" if direct else "implied_make"]))
                found += models
        return found


def extract_entities(articles: DataFrame, gazetteer: list[dict], special: list[dict] = (), limit: int = BROADCAST_BYTES) -> DataFrame:
    """One row per entity of (id, title, excerpt).

    The gazetteer is built once and goes to every executor once, as a broadcast of at most about limit bytes. A larger one
    is parted between makes, and each part reads the texts; as makes are judged apart, the rows are the same.
    """
    out = None
    names = [f.split()[0] for f in ENTITY_SCHEMA.split(", ")]
    types = [pa.int64(), *[pa.string()] * 5, pa.bool_(), pa.int32()]
    for piece in _pieces(gazetteer, max(1, limit // SPREAD)):
        models = {m["name"] for row in piece for m in row["models"]}
        found = _entities(articles, Gazetteer(piece, [rule for rule in special if rule["model"] in models]), names, types)
        out = found if out is None else out.unionByName(found)
    return articles.sparkSession.createDataFrame([], ENTITY_SCHEMA) if out is None else out


def _entities(articles: DataFrame, rules: Gazetteer, names: list[str], types: list[pa.DataType]) -> DataFrame:
    shared = articles.sparkSession.sparkContext.broadcast(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *e) for i, t, b in zip(*(c.to_pylist() for c in batch.columns), strict=True) for e in shared.value.entities(t, b)]
            yield pa.RecordBatch.from_arrays([pa.array([row[k] for row in rows], types[k]) for k in range(len(names))], names=names)

    return articles.select(F.col("id").cast("long"), "title", "excerpt").mapInArrow(run, ENTITY_SCHEMA)
