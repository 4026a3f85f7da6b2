"""Weight, length and width classes.

Every class set is a list of (inclusive upper edge, label) pairs plus the label
above the last edge and the label for NULL.  The measures are whole numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Bins:
    edges: tuple[tuple[int, str], ...]
    above: str
    missing: str

    def label(self, value: Column) -> Column:
        (edge, label), *rest = self.edges
        chain = F.when(value <= edge, F.lit(label))
        for edge, label in rest:
            chain = chain.when(value <= edge, F.lit(label))
        return chain.when(value.isNull(), F.lit(self.missing)).otherwise(F.lit(self.above))


# Fixed values.  The second edge is 7499, not 7500: a weight of exactly 7500
# belongs to the third class here and to the second class everywhere else.
# A missing weight falls into the top class.
TOTAL_WEIGHT_PASSAGE_HOUR = Bins(
    edges=(
        (3500, "klasse01_0-3500"),
        (7499, "klasse02_3501-7500"),
        (10000, "klasse03_7501-10000"),
        (20000, "klasse04_10001-20000"),
        (30000, "klasse05_20001-30000"),
        (40000, "klasse06_30001-40000"),
        (50000, "klasse07_40001-50000"),
        (60000, "klasse08_50001-60000"),
        (70000, "klasse09_60001-70000"),
        (80000, "klasse10_70001-80000"),
    ),
    above="klasse11_80001",
    missing="klasse11_80001",
)

# Fixed values.
TOTAL_WEIGHT_CORDON = Bins(
    edges=(
        (3500, "klasse 0 <= 3500"),
        (7500, "klasse 1 <= 7500"),
        (11250, "klasse 2 <= 11250"),
        (30000, "klasse 3 <= 30000"),
        (50000, "klasse 4 <= 50000"),
    ),
    above="klasse 5 > 50000",
    missing="onbekend",
)

# Fixed values.
TOTAL_WEIGHT_HEAVY = Bins(
    edges=(
        (3500, "klasse01_0-3500"),
        (7500, "klasse02_3501-7500"),
        (10000, "klasse03_7501-10000"),
        (20000, "klasse04_10001-20000"),
        (30000, "klasse05_20001-30000"),
        (40000, "klasse06_30001-40000"),
        (50000, "klasse07_40001-50000"),
        (60000, "klasse08_50001-60000"),
        (70000, "klasse09_60001-70000"),
    ),
    above="klasse10_70001",
    missing="onbekend",
)

# Fixed values.
EMPTY_WEIGHT_HEAVY = Bins(
    edges=(
        (3500, "klasse01_0-3500"),
        (7500, "klasse02_3501-7500"),
        (11250, "klasse03_7501-11250"),
        (15000, "klasse04_11251-15000"),
        (20000, "klasse05_15001-20000"),
        (30000, "klasse06_20001-30000"),
        (45000, "klasse07_30001-45000"),
    ),
    above="klasse08_45001",
    missing="onbekend",
)

# Fixed values.
LENGTH_HOUR = Bins(edges=((1000, "01 0t/m1000"),), above="02 >1000", missing="03 onbekend")
LENGTH_MINUTE = Bins(edges=((1000, "01 <=1000"),), above="02 >1000", missing="03 onbekend")

# Fixed values.  Exactly 140 is in neither class and counts as unknown.
WIDTH = Bins(
    edges=((139, "01 0-140"), (140, "03 onbekend")), above="02 >140", missing="03 onbekend"
)


def cordon_weight_class(country: Column, weight: Column) -> Column:
    """Foreign vehicles form one class; an unknown country is still weighed."""
    return F.when(country != "NL", F.lit("buitenland")).otherwise(
        TOTAL_WEIGHT_CORDON.label(weight)
    )


def home_or(country: Column, other: str) -> Column:
    """``NL`` for home vehicles, ``other`` for foreign and unknown ones."""
    return F.when(country == "NL", F.lit("NL")).otherwise(F.lit(other))
