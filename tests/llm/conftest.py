import pytest

pytest.importorskip("skarn.llm")
