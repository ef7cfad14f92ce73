"""Programs of several modules, passes over a program, and the effects that programs may call (P14-P18, P25-P27, IO15,
IO17, P21).

Sources are read by a function from a path to a text (or None), so modules may lie in any store; what is loaded goes
into one System, names with the prefix of their module. Everything here is about programs, which are small, and runs
on the driver."""

from __future__ import annotations

import posixpath
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gneiss.operators import logic
from gneiss.sources.shared import write_text

from .sexpr import TOKEN, Symbol, atom, to_sexp
from .system import HEADS, ProgramError, System

ENDING = ".pltg"


def reader(spark: SparkSession) -> Callable[[str], str | None]:
    """Reads a file of any store that Spark can read; None if there is none."""

    def read(path: str) -> str | None:
        to = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not to.getFileSystem(spark._jsc.hadoopConfiguration()).exists(to):
            return None
        return spark.read.text(path, wholetext=True).first()[0]

    return read


@dataclass(frozen=True)
class Context:
    """Where a module is loaded from."""

    file: str
    name: str
    main: bool

    def get(self, key: str) -> Any:
        known = {":file": self.file, ":dir": posixpath.dirname(self.file), ":name": self.name, ":main": self.main}
        if key not in known:
            raise ProgramError(f"unknown context key: {key}")
        return known[key]


@dataclass
class Loader:
    """Imports by dotted names: one leading dot is the folder of the module, each further one a folder up; without
    dots the module's folder comes first, then the library folders in order. A module is loaded once; imported again
    under another name it gets an alias, and a dotted name has its last part for an alias. A module that imports one
    that is still being loaded is an error."""

    system: System
    read: Callable[[str], str | None]
    libraries: tuple[str, ...] = ()
    lenient: bool = False
    names: dict[str, str] = field(default_factory=dict)  # path -> module
    aliases: dict[str, str] = field(default_factory=dict)  # other name -> module
    contexts: dict[str, Context] = field(default_factory=dict)
    log: list[tuple[str, str, str, str, int]] = field(default_factory=list)
    stack: list[Context] = field(default_factory=list)

    def load_main(self, path: str) -> System:
        """The program that begins at a file; its own names have no prefix."""
        self.system.effects |= {
            "import": lambda _, name: self._import(str(name)),
            "run-on-entry": lambda system, *exprs: self.stack[-1].main and [system.run(e) for e in exprs],
            "load-document": lambda system, name, at: self._document(str(name), posixpath.normpath(posixpath.join(self.stack[-1].get(":dir"), str(at)))),
            "context": lambda _, key: self._context(str(key)),
            **sinks(),
        } | self.system.effects
        self._load(Context(posixpath.normpath(path), "", True))
        return self.system

    def _path(self, name: str) -> tuple[str, str]:
        """(module, path) of an import."""
        bare = name.lstrip(".")
        dots = len(name) - len(bare)
        below = bare.replace(".", "/") + ENDING
        here = self.stack[-1].get(":dir") if self.stack else ""
        near = posixpath.normpath(posixpath.join(here, *[".."] * max(0, dots - 1), below))
        for path in [near, *([posixpath.normpath(posixpath.join(lib, below)) for lib in self.libraries] if not dots else [])]:
            if path in self.names or any(c.file == path for c in self.stack) or self.read(path) is not None:
                return bare, path
        raise ProgramError(f"no module {name} at {near}")

    def _import(self, name: str) -> str:
        module, path = self._path(name)
        if any(c.file == path for c in self.stack):
            raise ProgramError("circular import: " + " -> ".join([c.file for c in self.stack] + [path]))
        if path in self.names:
            if module != self.names[path]:
                self.aliases[module] = self.names[path]
            return self.names[path]
        self.names[path] = module
        if "." in module:
            self.aliases.setdefault(module.rsplit(".", 1)[-1], module)
        self._load(Context(path, module, False))
        return module

    def _load(self, context: Context) -> None:
        source = self.read(context.file)
        if source is None:
            raise ProgramError(f"no such file: {context.file}")
        self.contexts[context.name] = context
        self.stack.append(context)
        try:
            self.system.load(source, context.name, self.lenient, lambda name, line: self._resolved(name, context, line))
        finally:
            self.stack.pop()

    def _resolved(self, name: str, context: Context, line: int) -> str:
        """A name whose module part is an alias gets the module's own name; the change is logged."""
        parts = name.split(".")
        for i in range(len(parts) - 1, 0, -1):
            alias = ".".join(parts[:i])
            if alias in self.aliases and self.aliases[alias] != alias:
                full = ".".join([self.aliases[alias], *parts[i:]])
                self.log.append((name, full, alias, context.file, line))
                return full
        return name

    def _context(self, key: str) -> Any:
        module, _, prop = key.rpartition(".")
        return (self.contexts[module] if module else self.stack[-1]).get(prop)

    def _document(self, name: str, path: str) -> bool:
        text = self.read(path)
        if text is None:
            raise ProgramError(f"no document at {path}")
        more = self.system.spark.createDataFrame([(name, text)], "doc string, text string")
        self.system.documents = more if self.system.documents is None else self.system.documents.unionByName(more)
        return True

    def resolutions(self) -> DataFrame:
        """P27."""
        return self.system.spark.createDataFrame(self.log, "original string, resolved string, via string, file string, line int")

    def modules(self) -> DataFrame:
        rows = [(c.name, c.file, c.main, sorted(a for a, m in self.aliases.items() if m == c.name)) for c in self.contexts.values()]
        return self.system.spark.createDataFrame(rows, "module string, file string, main boolean, aliases array<string>")


def error_tree(system: System) -> DataFrame:
    """(root, cause, skipped): each directive that failed, why, and the names that were skipped for it."""
    why = {n: cause for n, _, status, cause in system.errors if status == "error"}
    below: dict[str, list[str]] = {n: [] for n in why}
    for n, _, status, root in system.errors:
        if status == "skipped":
            below.setdefault(root, []).append(n)
    return system.spark.createDataFrame([(r, why.get(r), sorted(n)) for r, n in below.items()], "root string, cause string, skipped array<string>")


# --- effects ------------------------------------------------------------------------------------------


def sinks(out: Callable[[str], None] = print) -> dict[str, Callable[..., Any]]:
    """IO17: print, consistency (:raise, :bool, :report) and verify-manual."""

    def say(system: System, *args: Any) -> bool:
        values = [system.evaluate(a) if isinstance(a, (Symbol, tuple)) else a for a in args]
        out(" ".join(str(v if isinstance(v, str) else to_sexp(v)).replace("\\n", "\n") for v in values))
        return True

    def consistency(system: System, mode: str = "") -> Any:
        if mode == ":report":
            return system.consistency()
        items = sorted((r["item"], r["name"]) for r in system.consistency().collect())  # of one program
        good = not any(item in logic.ISSUES for item, _ in items)
        if mode == ":bool":
            return good
        out("\n".join(f"{item}: {name}" for item, name in items) or "consistent")
        if mode == ":raise" and not good:
            raise ProgramError("the program isn't consistent")
        return True

    return {"print": say, "consistency": consistency, "verify-manual": lambda system, *names: system.verify_manual(*map(str, names))}


def repairs() -> dict[str, Callable[..., Any]]:
    """Effects with which a program mends itself: snapshot and rollback of a fact, patch-fact, and check-diff, which
    is true if a diff's values agree."""
    saved: dict[str, Any] = {}

    def snapshot(system: System, name: Any) -> bool:
        saved[str(name)] = system.entries[str(name)]
        return True

    def patch(system: System, name: Any, value: Any, document: str = "", quote: str = "", why: str = "") -> bool:
        old = system.entries[str(name)]
        found = ((document, quote),) if quote else ()
        system.entries[str(name)] = type(old)("fact", value, (), None if found else why or None, found, old.line, old.module)
        if found:
            system.verify_manual(str(name))
        return True

    def check(system: System, name: Any) -> bool:
        replaced = system.diffs[str(name)][0]
        return system.diff_values().where((F.col("diff") == str(name)) & (F.col("name") == replaced) & (F.col("status") != "same")).isEmpty()

    def rollback(system: System, name: Any) -> bool:
        system.entries[str(name)] = saved.pop(str(name))
        system.by_hand.discard(str(name))
        return True

    return {"snapshot": snapshot, "patch-fact": patch, "check-diff": check, "rollback": rollback}


# --- passes -------------------------------------------------------------------------------------------


@dataclass
class Passes:
    """P25: sources run one after the other over a system, with the state before each kept, so that a pass can be tried
    again with another source or left out."""

    system: System
    before: dict[int, System] = field(default_factory=dict)
    after: dict[int, System] = field(default_factory=dict)
    results: dict[int, tuple[str, str | None]] = field(default_factory=dict)
    notes: dict[int, list[str]] = field(default_factory=dict)

    def run(self, number: int, source: str) -> str | None:
        """The error, if there is one."""
        self.before[number] = self.system.snapshot()
        return self._execute(number, source)

    def _execute(self, number: int, source: str) -> str | None:
        error = None
        try:
            self.system.load(source)
        except ValueError as e:
            error = str(e)
        self.results[number] = (source, error)
        self.after[number] = self.system.snapshot()
        return error

    def retry(self, number: int, source: str, feedback: str) -> str | None:
        self._restore(number)
        self.notes.setdefault(number, []).append(feedback)
        return self._execute(number, source)

    def skip(self, number: int) -> None:
        self._restore(number)
        self.results[number] = ("", None)
        self.after[number] = self.system.snapshot()

    def _restore(self, number: int) -> None:
        if number in self.before:
            kept = self.before[number].snapshot()
            for name in ("entries", "diffs", "scopes", "by_hand", "errors", "failed"):
                setattr(self.system, name, getattr(kept, name))

    def finalize(self) -> DataFrame:
        """(pass, source, error, names): what each pass left."""
        rows = [(n, s, e, sorted(self.after[n].entries)) for n, (s, e) in sorted(self.results.items())]
        return self.system.spark.createDataFrame(rows, "pass int, source string, error string, names array<string>")


@dataclass
class Tracker:
    """The executable blocks of a literate file, run in order, with the state before each kept."""

    system: System
    blocks: list[str]
    done: list[System] = field(default_factory=list)
    errors: dict[int, str] = field(default_factory=dict)

    def execute(self, until: int | None = None) -> Tracker:
        """Run the blocks that haven't run, up to a number; the first that fails ends it."""
        for i in range(len(self.done), len(self.blocks) if until is None else until + 1):
            kept = self.system.snapshot()
            try:
                self.system.load(self.blocks[i])
            except ValueError as e:
                self.errors[i] = str(e)
                self._to(kept)
                break
            self.done.append(kept)
        return self

    def _to(self, kept: System) -> None:
        for name in ("entries", "diffs", "scopes", "by_hand"):
            setattr(self.system, name, getattr(kept.snapshot(), name))

    def rollback(self, number: int) -> Tracker:
        """As before that block ran."""
        if number < len(self.done):
            self._to(self.done[number])
            del self.done[number:]
            self.errors = {i: e for i, e in self.errors.items() if i < number}
        return self

    def reload(self, blocks: list[str]) -> Tracker:
        """New texts: what changed first, and all after it, runs again."""
        same = next((i for i, (a, b) in enumerate(zip(self.blocks, blocks, strict=False)) if a != b), min(len(self.blocks), len(blocks)))
        self.rollback(same)
        self.blocks = list(blocks)
        return self.execute()

    def reset(self) -> Tracker:
        return self.rollback(0)

    def status(self) -> DataFrame:
        """(block, status): done, failed or waiting."""
        rows = [(i, "done" if i < len(self.done) else "failed" if i in self.errors else "waiting") for i in range(len(self.blocks))]
        return self.system.spark.createDataFrame(rows, "block int, status string")


# --- exports ------------------------------------------------------------------------------------------


def qualified(source: str, owners: dict[str, str]) -> tuple[str, set[str]]:
    """(text, names it defines) of a source in which names that other modules own are written with their module.
    Only those names change; spaces and comments stay as they are."""
    found: list[tuple[int, int, str]] = []  # places of symbols that may be names of others
    defined: set[str] = set()
    open_: list[list[str]] = []
    at = 0
    while at < len(source):
        m = TOKEN.match(source, at)
        if m is None:
            break
        token, at = m["tok"], m.end()
        if token == "(":
            if open_:
                open_[-1].append("(")
            open_.append([])
        elif token == ")":
            open_ and open_.pop()
        elif token and open_:
            open_[-1].append(token)
            place = len(open_[-1])
            top = len(open_) == 1
            if top and place == 2 and open_[-1][0] in HEADS:
                defined.add(token)
            elif isinstance(atom(token), Symbol) and not token.startswith("?") and not (top and place == 1):
                found.append((m.start("tok"), m.end("tok"), token))
    out, last = [], 0
    for start, end, name in found:
        if name in owners and name not in defined:
            out += [source[last:start], f"{owners[name]}.{name}"]
            last = end
    return "".join([*out, source[last:]]), defined


def export_names(passes: list[tuple[str, str]]) -> tuple[dict[str, str], dict[str, str]]:
    """Sources of passes as modules that import those before them, and which module owns each name (the last that
    defines it)."""
    owners: dict[str, str] = {}
    out: dict[str, str] = {}
    for module, source in passes:
        text, defined = qualified(source, owners)
        imports = "\n".join(f"(import (quote {m}))" for m in out)
        out[module] = f"{imports}\n\n{text}" if imports else text
        owners |= dict.fromkeys(sorted(defined), module)
    return out, owners


def namespaced(text: Column, owners: dict[str, str], prefix: str = "") -> Column:
    """A text column with the names of [[type:name]] marks qualified by their module. owners: those of one program."""
    mark = r"\[\[(\w+):([^\]]+)\]\]"
    if not owners:
        return text
    known = F.create_map(*[F.lit(x) for n, m in owners.items() for x in (n, f"{prefix}{m}.{n}")])
    marks, types, names = (F.regexp_extract_all(text, F.lit(mark), F.lit(i)) for i in range(3))
    new = F.transform(F.arrays_zip(marks.alias("m"), types.alias("t"), names.alias("n")), lambda x: F.when(known[x["n"]].isNotNull(), F.concat(F.lit("[["), x["t"], F.lit(":"), known[x["n"]], F.lit("]]"))).otherwise(x["m"]))
    pieces = F.split(text, mark, -1)
    return F.array_join(F.transform(F.arrays_zip(pieces.alias("p"), F.array_append(new, F.lit("")).alias("r")), lambda x: F.concat(x["p"], x["r"])), "")


def export_project(spark: SparkSession, folder: str, passes: list[tuple[str, str]], documents: DataFrame, main: str) -> dict[str, str]:
    """IO15: a run as files: resources/doc=NAME (documents, by Spark's text writer), sources/MODULE, and main with its
    marks qualified. Returns the owners of the names."""
    sources, owners = export_names(passes)
    documents.select("doc", "text").write.mode("overwrite").partitionBy("doc").text(f"{folder}/resources")
    for module, text in sources.items():
        write_text(spark, f"{folder}/sources/{module}{ENDING}", text)
    shown = spark.range(1).select(namespaced(F.lit(main), owners, "sources.").alias("text")).first()["text"]
    write_text(spark, f"{folder}/main.pgmd", shown)
    return owners
