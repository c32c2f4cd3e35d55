"""Column-level helpers (``Column -> Column``), re-exported in one place.

They are defined next to the operators that use them; this module is the
public index for users who only want the scalar functions.
"""

from ..operators.corpus import entities_string, mark
from ..operators.dialog import ordinal_to_quarter, percent_points, percent_to_factor
from ..operators.evaluate import sign_col
from ..operators.graph import iri_local_name
from ..operators.series import inv_scale, next_period, period_index, predict, scale
from ..operators.text import biluo_to_iob, lemma
from ..sources.fixtures import cents, period_cols, rpid_col, term_label

__all__ = [
    "biluo_to_iob", "cents", "entities_string", "inv_scale", "iri_local_name", "lemma", "mark", "next_period",
    "ordinal_to_quarter", "percent_points", "percent_to_factor", "period_cols", "period_index", "predict",
    "rpid_col", "scale", "sign_col", "term_label",
]
