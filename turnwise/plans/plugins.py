"""Outside services behind small protocols, with deterministic stand-ins."""

from __future__ import annotations

import importlib.util
import itertools
import json
import re
import threading
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwise.functions import calls, markup

REWARDS: dict[str, Callable[..., object]] = {}


class Judge(Protocol):
    def __call__(self, prompts: list[str]) -> list[str]: ...


class Generator(Protocol):
    def __call__(self, prompts: list[str]) -> list[str]: ...


class Tokenizer(Protocol):
    def __call__(self, texts: list[str]) -> list[list[int]]: ...


def reward(source: str) -> Callable:
    """Register a reward under the data source that it serves."""
    def add(f: Callable[..., object]) -> Callable[..., object]:
        REWARDS[source] = f
        return f

    return add


def first_words(prompts: list[str]) -> list[str]:
    """A generator that answers with the first three words."""
    return [" ".join(p.split()[:3]) for p in prompts]


def parity_judge(prompts: list[str]) -> list[str]:
    """A judge that decides by the length of the prompt."""
    return ["CORRECT" if len(p) % 2 == 0 else "INCORRECT" for p in prompts]


def blank_tokenizer(texts: list[str]) -> list[list[int]]:
    return [[len(w) for w in t.split()] for t in texts]


def apply(df: DataFrame, service: Callable[[list[str]], list[str]], column: str, into: str) -> DataFrame:
    """Ask a service in Arrow batches; null prompts are not asked and stay null."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema.fields)}, `{into}` string"

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            some = b[column].notna()
            out = pd.Series([None] * len(b), index=b.index, dtype=object)
            out[some] = service(b.loc[some, column].tolist())
            yield b.assign(**{into: out})

    return df.mapInPandas(ask, schema)


def shorter_than(df: DataFrame, column: str, limit: int, tokenizer: Callable[[list[str]], list[list[int]]] = blank_tokenizer) -> DataFrame:
    """Rows whose text has at most `limit` tokens; null texts count as too long."""
    @F.pandas_udf("int")
    def size(texts: pd.Series) -> pd.Series:
        return pd.Series([len(x) for x in tokenizer(texts.fillna("").tolist())])

    return df.where(F.col(column).isNotNull() & (size(F.col(column)) <= limit))


# ---- calls to services -------------------------------------------------------------------------------------------


def patient(service: Callable[[list[str]], list[str]], tries: int = 5, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> Callable[[list[str]], list[str]]:
    """A service that is asked again after a failure, each time after twice the wait; the last failure is raised."""

    def ask(prompts: list[str]) -> list[str]:
        for k in range(tries):
            try:
                return service(prompts)
            except Exception:
                if k + 1 == tries:
                    raise
                sleep(wait * 2**k)
        raise ValueError("tries must be at least 1")

    return ask


def limited(service: Callable[[list[str]], list[str]], a_second: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> Callable[[list[str]], list[str]]:
    """A service that takes at most so many prompts a second in each task (a bucket of tokens that fills with time)."""
    state = {"tokens": a_second, "at": clock()}

    def ask(prompts: list[str]) -> list[str]:
        now = clock()
        state["tokens"] = min(a_second, state["tokens"] + (now - state["at"]) * a_second)
        state["at"] = now
        lacking = len(prompts) - state["tokens"]
        if lacking > 0:
            sleep(lacking / a_second)
        state["tokens"] -= len(prompts)
        return service(prompts)

    return ask


def timed(f: Callable[..., object], seconds: float, otherwise: object = None) -> Callable[..., object]:
    """A function whose result counts only if it is there in time; a thread that hangs is left behind."""

    def run(*args: object) -> object:
        box: list[object] = []
        t = threading.Thread(target=lambda: box.append(f(*args)), daemon=True)
        t.start()
        t.join(seconds)
        return box[0] if box else otherwise

    return run


def spread_over(*services: Callable[[list[str]], list[str]]) -> Callable[[list[str]], list[str]]:
    """Several clients of one kind, asked in turn."""
    turn = itertools.cycle(services)
    return lambda prompts: next(turn)(prompts)


def repaired(df: DataFrame, service: Callable[[list[str]], list[str]], column: str, good: Callable[[Column], Column], rounds: int = 3) -> DataFrame:
    """Texts that are not good are handed to a service again, at most so many times; what is still broken stays as it is."""
    for _ in range(rounds):
        asked = apply(df.withColumn("_ask", F.when(~F.coalesce(good(F.col(column)), F.lit(False)), F.col(column))), service, "_ask", "_new")
        df = asked.withColumn(column, F.coalesce("_new", column)).drop("_ask", "_new")
    return df


def length_budget(prompt_tokens: Column, longest: int, otherwise: int = 1000) -> Column:
    """Tokens that a response may have: what the context leaves after the prompt and two more, else a fixed number."""
    return F.when(prompt_tokens + 2 < longest, F.lit(longest) - prompt_tokens - 2).otherwise(F.lit(otherwise))


# ---- named parts -------------------------------------------------------------------------------------------------


class Registry(dict):
    """Named parts of one kind (parsers, datasets, generators, tools, loops); a name is given once, an unknown one is an error."""

    def __init__(self, kind: str) -> None:
        super().__init__()
        self.kind = kind

    def register(self, name: str) -> Callable:
        def add(part: object) -> object:
            if self.setdefault(name, part) is not part:
                raise ValueError(f"{self.kind} {name} is taken")
            return part

        return add

    def named(self, name: str) -> object:
        if name not in self:
            raise ValueError(f"no {self.kind} {name}; there are {sorted(self)}")
        return self[name]


PARSERS, GENERATORS, DATASETS, TOOLS, LOOPS = (Registry(k) for k in ("parser", "generator", "dataset", "tool", "loop"))
PARSERS.register("tags")(lambda c: (markup.named_calls(c), calls.without_calls(c)))
PARSERS.register("channels")(lambda c: (markup.channel_calls(c), markup.without_channel_calls(c)))
GENERATORS.register("first_row")(lambda df: df.limit(1))


def parsed_calls(name: str, text: Column) -> tuple[Column, Column]:
    """The calls of a text and the rest of it, by a named parser."""
    return PARSERS.named(name)(text)


def function_from(path: str, name: str) -> Callable[..., object]:
    """A function of a Python file that the caller names and trusts, as a custom reward."""
    spec = importlib.util.spec_from_file_location("custom", path)
    if spec is None or spec.loader is None:
        raise FileNotFoundError(path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    if not hasattr(module, name):
        raise AttributeError(f"{path} has no {name}")
    return getattr(module, name)


class Tool:
    """A tool: created for a row, executed with arguments, and released. Subclasses answer in `execute`."""

    def __init__(self, schema: dict) -> None:
        self.schema = schema
        self.open: dict[str, dict] = {}

    def create(self, instance: str, **given: object) -> str:
        self.open[instance] = dict(given)
        return instance

    def execute(self, instance: str, arguments: dict) -> tuple[str, float]:
        """The response text and a reward of the step."""
        return json.dumps({"name": self.schema.get("name"), "arguments": arguments}, sort_keys=True), 0.0

    def reward(self, instance: str) -> float:
        return 0.0

    def release(self, instance: str) -> None:
        self.open.pop(instance, None)


TOOLS.register("echo")(Tool)


def tools_from(config: list[dict]) -> dict[str, Tool]:
    """Tools by name from a configuration of kind and schema each."""
    return {c["schema"]["name"]: TOOLS.named(c.get("kind", "echo"))(c["schema"]) for c in config}


def agent_loop(generate: Callable[[list[str]], list[str]], tools: dict[str, Tool], prompt: str, key: str, most_turns: int = 4, most_calls: int = 4, most_words: int = 512) -> dict[str, object]:
    """One row's loop: generate, run the calls of the answer (at most so many at once), append their responses, and go on until an answer calls nothing or a bound is reached.

    mask has a 1 for each word that was generated and a 0 for each word of a response."""
    text, mask, turns, made, state = prompt, [], 0, 0, "pending"
    while state != "terminated":
        said = generate([text])[0]
        turns += 1
        mask += [1] * len(said.split())
        text += f"\n{said}"
        bodies = re.findall(r"(?s)<tool_call>\n(.*?)\n</tool_call>", said)[:most_calls]
        if not bodies or turns >= most_turns or len(mask) >= most_words:
            break
        for k, body in enumerate(bodies):
            try:
                call = json.loads(body)
                tool = tools[call["name"]]
                instance = tool.create(f"{key}-{turns}-{k}")
                answer, _ = tool.execute(instance, call["arguments"])
                tool.release(instance)
            except (ValueError, KeyError, TypeError) as e:
                answer = f"error: {type(e).__name__}"
            made += 1
            block = f"<tool_response>\n{answer}\n</tool_response>"
            if len(mask) + len(block.split()) > most_words:
                state = "terminated"
                break
            mask += [0] * len(block.split())
            text += f"\n{block}"
    return {"text": text, "mask": mask, "turns": turns, "calls": made}


LOOPS.register("tools")(agent_loop)


def run_loops(df: DataFrame, generate: Callable[[list[str]], list[str]], tools: list[dict], prompt: str, key: str, loop: str = "tools", **bounds: int) -> DataFrame:
    """key, text, mask, turns, calls of each row's loop, run where the row is."""
    run = LOOPS.named(loop)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine = tools_from(tools)
        for b in batches:
            yield pd.DataFrame([{key: k, **run(generate, mine, p or "", str(k), **bounds)} for k, p in zip(b[key], b[prompt])], columns=[key, "text", "mask", "turns", "calls"])

    return df.select(key, prompt).mapInPandas(work, f"`{key}` {df.schema[key].dataType.simpleString()}, text string, mask array<int>, turns int, calls int")


def dispatched(df: DataFrame, ranks: int, work: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, order: str = "pos") -> DataFrame:
    """A batch cut into ranges of its order, one a rank, worked on and put together again."""
    return df.repartitionByRange(ranks, order).sortWithinPartitions(order).mapInPandas(work, schema)
