"""Text of typed cells, in the form Python prints them, as SQL over a column name.

``CAST AS STRING`` differs for doubles outside 1e-3..1e7 (``1.0E7``), for NaN
and infinity and for fractions of a second (trailing zeros cut).
"""

from __future__ import annotations


def render_double(column: str) -> str:
    plain = f"CAST({column} AS string)"
    spelled = rf"regexp_replace(CAST(CAST({plain} AS decimal(38,22)) AS string), '([.][0-9]+?)0+$', '$1')"
    exponent = f"CAST(split_part({plain}, 'E', 2) AS int)"
    mantissa = f"regexp_replace(split_part({plain}, 'E', 1), '[.]0$', '')"
    scientific = (
        f"concat({mantissa}, if({exponent} < 0, 'e-', 'e+'), if(abs({exponent}) < 10, '0', ''), abs({exponent}))"
    )
    return f"""CASE
        WHEN isnan({column}) THEN 'nan'
        WHEN abs({column}) = double('infinity') THEN if({column} > 0, 'inf', '-inf')
        WHEN NOT contains({plain}, 'E') THEN {plain}
        WHEN abs({column}) >= 1e-4 AND abs({column}) < 1e16 THEN {spelled}
        ELSE {scientific} END"""


def render_timestamp(column: str) -> str:
    """``yyyy-MM-dd HH:mm:ss``, with six digits of a second if there are any."""
    plain = f"CAST({column} AS string)"
    return f"if(contains({plain}, '.'), rpad({plain}, 26, '0'), {plain})"
