"""Text analysis: text to terms, as column expressions or on the driver.

The order is fixed: lower case, tokens, compound parts, shortest length, stop words, stem.
Stemming is the only step that isn't a built-in expression; it is an Arrow-batched function
whose cache makes it a dictionary lookup per token, so the terms never have to be shuffled.
"""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skarn.functions.porter import stem
from skarn.functions.terms import TOKEN

# English stop words.
STOPWORDS = """i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself she she's her hers herself it it's its itself they them their theirs themselves
what which who whom this that that'll these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into
through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so
than too very s t can will just don don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn
mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't""".split()


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stemmed(arrays: pd.Series) -> pd.Series:
    return arrays.map(lambda terms: None if terms is None else [x for x in (stem(t).strip("'-") for t in terms) if x])


@dataclass(frozen=True)
class Analyzer:
    """The switches of the analysis. With ``lowercase=False`` upper-case letters are no token characters and split words."""

    lowercase: bool = True
    remove_stopwords: bool = True
    stem: bool = True
    min_token_length: int = 2
    split_compounds: bool = True

    def config(self) -> dict:
        return asdict(self)

    @classmethod
    def from_config(cls, config: dict) -> "Analyzer":
        return cls(**{k: v for k, v in config.items() if k in cls.__dataclass_fields__})

    def analyze(self, text: Column) -> Column:
        """Terms in order, repeats kept; null for null."""
        t = F.lower(text) if self.lowercase else text
        out = F.regexp_extract_all(t, F.lit(f"({TOKEN})"), F.lit(1))
        if self.split_compounds:
            out = F.flatten(F.transform(out, lambda x: F.when(F.contains(x, F.lit("-")), F.concat(F.array(x), F.split(x, "-"))).otherwise(F.array(x))))
        if self.min_token_length > 1:
            out = F.filter(out, lambda x: F.length(x) >= self.min_token_length)
        if self.remove_stopwords:
            out = F.filter(out, lambda x: ~x.isin(STOPWORDS))
        return _stemmed(out) if self.stem else out

    def analyze_text(self, text: str | None) -> list[str]:
        """The same for one text on the driver: queries."""
        t = (text or "").lower() if self.lowercase else text or ""
        out = re.findall(TOKEN, t)
        if self.split_compounds:
            out = [p for x in out for p in ([x, *x.split("-")] if "-" in x else [x])]
        if self.min_token_length > 1:
            out = [x for x in out if len(x) >= self.min_token_length]
        if self.remove_stopwords:
            out = [x for x in out if x not in _STOPS]
        return [x for x in (stem(x).strip("'-") for x in out) if x] if self.stem else out


_STOPS = frozenset(STOPWORDS)
