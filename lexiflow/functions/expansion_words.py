"""Dictionaries of query expansion."""

from __future__ import annotations

# Terms and what they add, one a line.
_TERMS = """
carcinoma: cancer; malignancy; ca
oesophagus: esophagus
esophagus: oesophagus
haemoglobin: hemoglobin
haemorrhage: hemorrhage; bleeding
oedema: edema
foetal: fetal
foetus: fetus
color: colour
anaemia: anemia
hypokalaemia: hypokalemia
hyperkalaemia: hyperkalemia
tympanic membrane: eardrum
hcn: hyperpolarization-activated cyclic nucleotide-gated; funny current; if current; if channels; pacemaker current
trali: transfusion-related acute lung injury
siadh: syndrome of inappropriate antidiuretic hormone secretion; inappropriate adh
pcos: polycystic ovary syndrome; stein leventhal
rcc: renal cell carcinoma; hypernephroma
cmv: cytomegalovirus
pet: positron emission tomography
fdg: fluorodeoxyglucose; f-18 fdg
gdm: gestational diabetes mellitus
bpp: biophysical profile; manning score
ogtt: oral glucose tolerance test
opg: orthopantomogram; panoramic radiograph
ebv: epstein barr virus
psgn: post streptococcal glomerulonephritis; poststreptococcal gn
rhd: rheumatic heart disease
tb: tuberculosis
ayre's spatula: pap smear spatula; cervical cytology spatula
frankfort: frankfurt; fh plane; porion orbitale
inca bone: interparietal bone; goethe's ossicle; lambda bone
wormian: sutural bone
dicor: castable glass ceramic
mta: mineral trioxide aggregate
ah plus: epoxy resin sealer
gutta percha: gp
ethambutol: optic neuritis; red green color blindness
ewing: ewsr1 fli1; t(11;22); primitive neuroectodermal tumor; pnet
prucalopride: 5-ht4 agonist; chronic constipation
lichen planus: violaceous flat topped papules; wickham striae
dj stent: double j stent; ureteric stent; ureteral stent; j stent
vldl: very low density lipoprotein
ldl: low density lipoprotein
hdl: high density lipoprotein
ggt: gamma glutamyl transferase
ast: sgot; aspartate aminotransferase
alt: sgpt; alanine aminotransferase
alp: alkaline phosphatase
niv: non-invasive ventilation; noninvasive ventilation
simv: synchronized intermittent mandatory ventilation
acmv: assist control ventilation; ac mode
psv: pressure support ventilation
"""

# Expressions and what they add; between them the words one of which a text with a match has.
_PHRASES = r"""
\bwhich of the following\b | following | exam question; mcq; select one; choose the correct; except; true/false
\bexcept\b | except | not; is NOT; false statement; all are true except
\bmost common\b | common | commonest; mc; frequent; prevalent
\bsite\b | site | location; region; segment
\bacid[- ]?base\b | acid base acidbase | arterial blood gas; abg; acidemia alkalemia
\bcarcinoma\b | carcinoma | cancer; malignancy; ca
\bgingiv\w+ | gingiv* | periodontal; gum; gingiva
\bana?esthesia | anesthesia* anaesthesia* | sedation; anesthetic; monitoring
\bfracture\b | fracture | break; fx
\bhypotension\b | hypotension | low blood pressure; bp drop
\bmyocard\w+ | myocard* | heart muscle; cardiac
\bviab(le|ility)\b | viable viability | hibernating myocardium; myocardial viability
\bpap smear\b | pap | cervical cytology; papanicolaou test
\bperiodontal\b | periodontal | gum; gingival
\bosseous\b | osseous | bony
\bureter(al|ic)\b | ureteral ureteric | double j stent; dj stent; j stent
\bconfidence interval\b/\bCI\b | confidence ci | 95% CI; margin of error; precision
\bcase[- ]?control\b | case control casecontrol | retrospective study; odds ratio
\bcohort\b | cohort | prospective study; relative risk
\brandomi[sz]ed\b | randomised randomized | randomized; RCT
\bflow cytometry\b | cytometry | facs; forward scatter; side scatter
"""

# Two spellings of a word.
SPELLINGS = (("hemorrhage", "haemorrhage"), ("fetus", "foetus"), ("edema", "oedema"), ("color", "colour"), ("esophagus", "oesophagus"))

# Words that no term begins or ends with.
WITHOUT_CONTENT = tuple(
    """a an the is are was were be been being of for to in on at from by and or if with without
which who whom whose that this these those into over under after before during
not except all any most more less least""".split()
)


def terms() -> dict[str, list[str]]:
    pairs = [line.split(": ", 1) for line in _TERMS.strip().split("\n")]
    return {k: v.split("; ") for k, v in pairs}


def phrases() -> list[tuple[str, list[list[str]], list[str]]]:
    """Expression (of any case, over words of any script), anchors (a word each), additions."""
    out = []
    for line in _PHRASES.strip().split("\n"):
        pattern, anchors, extra = line.split(" | ")
        out.append((pattern.replace("/", "|"), [[a] for a in anchors.split()], extra.split("; ")))
    return out
