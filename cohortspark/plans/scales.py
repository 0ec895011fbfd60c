"""The ten questionnaires as data."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Scale:
    """How one questionnaire is laid out and scored.

    ``layout``: ``likert`` (``<columns>_<item>``), ``slider`` (``<item>_<columns>_<x>``),
    ``pairs`` (two columns per item), ``two_keys`` (item and kind in the name) or
    ``binary`` (answer codes 1/2). ``patch`` stands in for a missing answer.
    """

    name: str
    layout: str
    fun: str = "sum"
    patch: float | None = None
    points: int | None = None
    minimum: float | None = None
    ends_sum: float | None = None
    subscales: str = "key"
    positive_items: tuple[int, ...] = ()
    kinds: tuple[str, ...] = ()
    ignore: tuple[str, ...] = ()


# Layouts, patches, response ranges and item lists of the questionnaires.
I_PANAS_SF = Scale(
    "i_panas_sf", "likert", patch=1, subscales="items", positive_items=(3, 5, 7, 8, 10)
)
BPQ = Scale("bpq", "binary")
TAS20 = Scale("tas20", "likert", patch=3, ends_sum=6)
DERS = Scale("ders", "likert", patch=0, ends_sum=6)
ALS18 = Scale("als18", "slider", patch=0, points=4, minimum=0)
BEQ = Scale("beq", "slider", fun="mean", patch=4, points=7, minimum=1, ends_sum=8)
CESDR = Scale("cesdr", "pairs", patch=0, kinds=("cesdr1", "cesdr2"))
STICSA = Scale("sticsa", "two_keys", patch=1, kinds=("state", "trait"))
SWLS = Scale("swls", "slider", patch=4, points=7, minimum=1, subscales="none")
IRQ = Scale("irq", "slider", patch=4, points=7, minimum=1, ignore=("irqItemOrder",))

ROUND_SCALES = (I_PANAS_SF, BPQ, TAS20, DERS)
FOLLOWUP_SCALES = (ALS18, BEQ, CESDR, STICSA, SWLS, IRQ)

# Missing-count outputs and the column prefixes they watch.
ROUND_MISSING = {
    "nas_i_panas_sf": "i_panas_sf",
    "nas_sns": "sns",
    "nas_bpq": "bpq",
    "nas_tas20": "tas20",
    "nas_ders": "ders",
}
FOLLOWUP_MISSING = {
    "nas_als18": "als18",
    "nas_beq": "beq",
    "nas_cesdr": "cesdr1",
    "nas_sticsa_state": "sticsa_state",
    "nas_sticsa_trait": "sticsa_trait",
    "nas_swls": "swls",
    "nas_irq": "irq_",
}

# Totals built from every column whose name contains the text.
ROUND_TOTALS = {"bpq_total": "bpq", "tas20_total": "tas20", "ders_total": "ders"}
FOLLOWUP_TOTALS = {
    "als18_total": "als18",
    "beq_total": "beq",
    "cesdr_total": "cesdr",
    "sticsa_state_total": "sticsa_state",
    "sticsa_trait_total": "sticsa_trait",
    "irq_total": "irq",
}
MEAN_TOTALS = ("beq_total",)

# A follow-up total is dropped when more answers than this are missing.
MISSING_LIMITS = {
    "cesdr_total": ("nas_cesdr", 10),
    "sticsa_state_total": ("nas_sticsa_state", 10),
    "sticsa_trait_total": ("nas_sticsa_trait", 10),
    "als18_total": ("nas_als18", 9),
    "beq_total": ("nas_beq", 8),
    "irq_total": ("nas_irq", 8),
    "swls": ("nas_swls", 2),
}

# Scores that are standardised over all participants, and the PCA input.
ROUND_Z = ("i_panas_sf_neg", "i_panas_sf_pos", "bpq_total", "tas20_total", "ders_total")
FOLLOWUP_Z = (
    "cesdr_total", "sticsa_state_total", "sticsa_trait_total", "als18_total", "beq_total",
    "irq_total", "swls",
)
PCA_COLUMNS = (
    "i_panas_sf_pos", "i_panas_sf_neg", "bpq_total", "tas20_total", "ders_total", "cesdr_total",
    "sticsa_state_total", "sticsa_trait_total", "als18_total", "beq_total", "irq_total", "swls",
)


@dataclass(frozen=True)
class KeyItem:
    """One question of a questionnaire key."""

    item: int | None
    subscale: str | None
    reverse: bool | None = None


Key = dict[str, list[KeyItem]]


@dataclass
class SurveyKeys:
    """Questionnaire keys by scale name."""

    items: Key = field(default_factory=dict)

    def entries(self, scale: str, item: int | None) -> list[KeyItem]:
        """All key entries of an item; an unlisted one has no subscale and no flag."""
        listed = [entry for entry in self.items.get(scale, ()) if entry.item == item]
        return listed or [KeyItem(item, None, None)]
