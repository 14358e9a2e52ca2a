"""Language votes: means that are equal tie, in whatever order their votes are added."""

import pytest

from cueloom.operators import prepare as P

pytestmark = pytest.mark.usefixtures("spark")


def test_equal_means_tie_by_code(spark):
    votes = [(1, "tr", 0.1), (1, "tr", 0.2), (1, "tr", 0.3), (1, "ja", 0.3), (1, "ja", 0.2), (1, "ja", 0.1), (2, "ab", 0.5), (2, "a", 0.5), (3, "en", None), (3, "tr", 0.0), (3, None, 1.0)]
    d = spark.createDataFrame(votes, "media_id bigint, lang string, confidence double").coalesce(1)
    got = {r.media_id: (r.lang, r.probability) for r in P.majority_language(d).collect()}
    assert got[1] == ("ja", pytest.approx(0.1)) and got[2] == ("a", 0.25) and got[3] == ("tr", 0.0)
