"""A small invented study written as CSV files."""

import csv
import random
from pathlib import Path

ITEMS = {"tas20": 20, "ders": 36, "bpq": 8, "als18": 18, "beq": 16, "cesdr": 20, "sticsa": 21, "irq": 16}


def write(path, header, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        out.writerow(header)
        out.writerows(rows)
    return str(path)


def keys(folder):
    rng = random.Random(0)
    made = {}
    for scale, n in ITEMS.items():
        sub = lambda i: ["First Part", "Second/Part", "Third-part"][i % 3]
        if scale == "bpq":
            rows = [[f"{i}. I feel so{'*' if i % 4 == 0 else ''}", sub(i)] for i in range(1, n + 1)]
            made[scale] = write(folder / "bpq_raw.csv", ["question", "subscale"], rows)
            continue
        number = "q.num" if scale == "ders" else "q.number"
        name = "subscale.6" if scale == "als18" else "subscale"
        header = [number, "q.text", name, "reverse"]
        rows = [[i, "text", sub(i), str(rng.random() < 0.3).upper()] for i in range(1, n + 1)]
        made[scale] = write(folder / f"{scale}_raw.csv", header, rows)
    return made


def rounds(folder, people, name, rng):
    items = [f"i_panas_sf_{i}" for i in range(1, 11)] + [f"bpq_q{i}" for i in range(1, 9)]
    items += [f"tas20_{i}" for i in range(1, 21)] + [f"ders_{i}" for i in range(1, 37)]
    numeric, labels = [], []
    for subj in people + people[:2]:  # two repeat visits at the end: older ones
        mood = rng.gauss(0, 1)
        codes = []
        for c in items:
            top = 2 if c.startswith("bpq") else 5
            code = min(top, max(1, round(top / 2 + 0.5 + mood + rng.gauss(0, 1))))
            codes.append(-99 if rng.random() < 0.03 else code)
        numeric.append([subj, *codes])
        texts = ["-99" if c == -99 else f"level {c}" for c in codes]
        age = "20" if subj != people[-1] else "60"
        ticks = ["On" if rng.random() < 0.9 else "Off", ""]
        races = ["Asian" if rng.random() < 0.5 else "", "White" if rng.random() < 0.5 else ""]
        labels.append([subj, age, "I write w/Right", "Woman", *races, "no", "college", *ticks, *texts, 'say "a",\nb'])
    header = ["prolific_id", *items]
    label_header = ["prolific_id", "age", "handedness", "gender", "race_1", "race_2", "ethnicity", "edu",
                    "ses_7", "ses_8", *items, "dx_med"]
    extra = lambda h: [["about " + c for c in h], ["{id}" for _ in h]]
    return (
        write(folder / f"{name}_numeric.csv", header, extra(header) + numeric),
        write(folder / f"{name}_choicetext.csv", label_header, extra(label_header) + labels),
    )


def followup(folder, people, rng):
    names = [f"{i}_als18_1" for i in range(1, 19)] + [f"{i}_beq_1" for i in range(1, 17)]
    names += [f"{i}_swls_1" for i in range(1, 6)] + [f"{i}_irq_1" for i in range(1, 17)]
    names += [f"{i}_cesdr1_1" for i in range(1, 21)] + [f"{i}_cesdr2" for i in range(1, 21)]
    names += [f"{i}_sticsa_{k}_1" for k in ("state", "trait") for i in range(1, 22)]
    rows = []
    for n, subj in enumerate(people + people[:1]):
        mood = rng.gauss(0, 20)
        cell = lambda c: (
            rng.randint(0, 7) if "cesdr1" in c else rng.choice([1, 2, 2, 2]) if "cesdr2" in c
            else round(min(100, max(0, 50 + mood + rng.gauss(0, 15))))
        )
        answers = ["" if rng.random() < 0.03 else cell(c) for c in names]
        rows.append([f"R_{n}", subj, f"2020-01-{n % 28 + 1:02d} 10:00:00", "1|2|3", *answers])
    header = ["ResponseId", "subj_num", "StartDate", "irqItemOrder", *names]
    extra = [["about " + c for c in header], ["{id}" for _ in header]]
    rng.shuffle(rows)
    return write(folder / "followup_numeric.csv", header, extra + rows)


def stimuli(folder):
    rows = [[f"s{i}.gif", round(i / 53 * 5, 3), round(5 - i / 53 * 5, 3), round(i / 53 * 4 - 2, 3)] for i in range(54)]
    return write(folder / "info.csv", ["number", "fname", "amuse", "fear", "bipolar"], [[i, *r] for i, r in enumerate(rows)])


def logs(folder, people, positive, negative, names, rng, own_start):
    header = ["Event Index", "Participant Public ID", "Trial Number", "Screen Name", "Reaction Time", "Response",
              "Timed Out", "Spreadsheet Name", "display", "promptLText", "promptRText", "randomise_trials",
              "counterbalance-hhri", "counterbalance-ib52", "counterbalance-57z1", "counterbalance-4r2c",
              *[f"fnameV{i}" for i in range(1, 6)]]
    if own_start:
        header.append("sliderStart")
    paths = []
    for f, name in enumerate(names):
        rows = []
        for subj in people[f :: len(names)]:
            shift = rng.gauss(0, 0.8)
            version = rng.randint(1, 5)
            n = 0
            for kind in ("trialCat", "trialCont"):
                for left, right in (("Neutral", positive), ("Neutral", negative), (positive, negative)):
                    size = 43 if left == "Neutral" else 54
                    for t in range(size):
                        n += 1
                        level = t / 53
                        if left == "Neutral" and right == negative:
                            level = 1 - level
                        lean = -2 + 4 * level + shift
                        start = rng.randint(20, 80) if own_start else 50
                        rt = 5000 + (rng.randint(600, 2000) if subj != people[1] else rng.randint(10, 400))
                        base = [subj, n, "gif", rt]
                        late = rng.random() < 0.01
                        if kind == "trialCat":
                            hit = rng.random() < 1 / (1 + 2.718 ** -lean)
                            label = right if hit else left
                            base += ["999" if late else label.upper(), "1" if late else "0"]
                        else:
                            value = start if late else min(100, max(0, round(50 + 20 * lean + rng.gauss(0, 15))))
                            base += [str(value), "0"]
                        fnames = [f"s{(t * (i == version) + 3 * (i != version)) % 54}.gif" for i in range(1, 6)]
                        tail = [f"list{'CatFirst' if f % 2 == 0 else 'ContFirst'}", kind, left.title(), right.title(), 1,
                                "", f"fnameV{version}", "", "", *fnames]
                        tail += [start] if own_start else []
                        rows.append([len(rows), *base, *tail])
                        if kind == "trialCont":
                            submit = list(rows[-1])
                            submit[0] = len(rows)
                            submit[5] = "submitResp"
                            submit[6] = "1" if late else "0"
                            rows.append(submit)
            rows.append([len(rows), subj, 0, "instructions", 1, "ok", "", "list", "", "", "", "", "", "", "", "", *[""] * 5, *([""] if own_start else [])])
        head = header if f % 2 == 0 else [*header[:5], *reversed(header[5:])]
        order = [header.index(h) for h in head]
        paths.append(write(folder / f"{name}.csv", head, [[r[i] for i in order] for r in rows]))
    return paths


def study(folder, people=40, seed=1):
    """Arguments of ``Study`` for an invented data set under ``folder``."""
    folder, rng = Path(folder), random.Random(seed)
    first = [f"p{i}" for i in range(people)]
    second = [f"q{i}" for i in range(people)]
    return {
        "rounds": {
            "amusement_fear": rounds(folder / "qs", first, "rd1", rng),
            "positive_negative": rounds(folder / "qs", second, "rd2", rng),
        },
        "followup": followup(folder / "qs", first + second, rng),
        "keys": keys(folder / "keys"),
        "stimuli": stimuli(folder / "stim"),
        "logs": {
            "amusement_fear": logs(folder / "af", first, "AMUSEMENT", "FEAR", ["amuse_cat_first", "amuse cont_first"], rng, False),
            "positive_negative": logs(folder / "pn", second, "POSITIVE", "NEGATIVE", ["pos_cat_first", "neg_cont_first"], rng, True),
        },
        "output": str(folder / "out"),
    }
