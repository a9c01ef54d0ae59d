"""Term packs of filing language, as data.

Fixed values: results depend on exactly these words, phrases, scopes and heading patterns. Everything that uses them
takes a TermPacks, so a caller can bring packs of their own.
"""

from __future__ import annotations

from dataclasses import dataclass, field


def _terms(text: str) -> tuple[str, ...]:
    return tuple(x.strip() for x in text.replace("\n", " ").split(";") if x.strip())


def _named(text: str) -> dict[str, tuple[str, ...]]:
    """Lines `name: term; term`, further terms on indented lines."""
    out: dict[str, str] = {}
    name = ""
    for line in text.strip().splitlines():
        if not line.startswith(" "):
            name, _, line = line.partition(":")
            out[name] = ""
        out[name] += f" {line.strip()}"
    return {k: _terms(v) for k, v in out.items()}


# Token packs.
NEGATIVE = _terms("""
loss; losses; decline; declined; adverse; adversely; impairment; deterioration; weakness; weak; negative; deficit;
shortfall; downgrade; failure; failed; harm; damage; breach; default; impaired; impair; impairments; disruption;
disruptions; disrupted; bankruptcy; bankrupt; insolvency; insolvent; delinquency; delinquencies; delinquent;
writedown; writeoff; chargeoff; chargeoffs; recall; recalls; outage; outages; misstatement; misstatements; fraud;
fraudulent
""")
UNCERTAINTY = _terms("""
may; might; could; uncertain; uncertainty; volatility; volatile; unpredictable; depend; depends; possible;
potentially; approximate; approximately; contingency; contingencies; contingent; fluctuate; fluctuates; fluctuation;
fluctuations; variable; variability; unresolved; pending; exposure; exposures; exposed; susceptible; unforeseen;
undetermined; assumption; assumptions
""")
LITIGIOUS = _terms("""
litigation; lawsuit; investigation; inquiry; regulatory; enforcement; claim; claims; proceeding; proceedings;
subpoena; subpoenas; settlement; complaint; penalty; penalties; plaintiff; defendant; arbitration; arbitrations;
appeal; appeals; appellate; antitrust; allegation; allegations; alleged; damages; injunction; injunctive;
indemnification; indemnify; sanction; sanctions; decree
""")
CONSTRAINING = _terms("""
covenant; covenants; restriction; restrictions; limitation; limitations; mandatory; obligation; obligations;
compliance; constraint; constraints; default; defaults; breach; breaches; restricted; restrictive; waiver; waivers;
forbearance; acceleration; accelerated; maturity; maturities; refinance; refinancing; collateral; lien; liens;
pledged; encumbered; obligated
""")
WEAK_MODAL = _terms("may; might; could; possibly; possible")
MODERATE_MODAL = _terms("should; would; expect; expects; believe; believes; intend; intends")
STRONG_MODAL = _terms("must; will; shall; required; obligated")
SEVERITY = _terms("""
severe; severely; material; materially; significant; significantly; substantial; substantially; critical; adverse;
major; acute; persistent; prolonged; widespread; recurring
""")

# Phrase packs.
BOILERPLATE = _terms("""
actual results could differ materially; could adversely affect our business; may materially adversely affect;
we cannot assure you; we cannot predict all such risk factors; subject to risks and uncertainties;
you should not place undue reliance; should not place undue reliance; from time to time;
there can be no assurance; we face risks and uncertainties; risks and uncertainties described below;
could materially and adversely affect; material adverse effect on our business; no assurance can be given;
may not be successful; may fail to; subject to a number of risks; unknown risks and uncertainties; not exhaustive
""")
LEGAL_REGULATORY = _terms("""
civil investigative demand; wells notice; consent order; cease and desist order; regulatory enforcement action;
department of justice; sec investigation; subpoena from the sec
""")
GEOGRAPHY = _terms("""
americas; europe; asia; china; japan; international; domestic; global; region; regions; country; countries;
north america; latin america; emea; european union; apac
""")
SEGMENT = _terms("""
segment; segments; division; divisions; business unit; product line; brand; brands; channel; channels; market;
markets; platform; platforms; subscription; subscriptions; service line; service lines; geography; geographies
""")
DENSITIES = _named("""
uncertainty_term_density: may; might; could; uncertain; uncertainty; subject to; subject to change; volatile;
  unpredictable; known trends; known uncertainties; reasonably likely; unable to predict; cannot predict;
  remains uncertain; uncertain timing; forward-looking statements; difficult to forecast
demand_softness_density: soft demand; demand declined; lower demand; weakened demand; demand softness;
  order slowdown; weaker demand; reduced demand; decline in demand; order cancellations; delayed orders;
  customer destocking; inventory correction; lower volumes; volume decline; sales slowdown; bookings declined;
  backlog decreased
margin_pressure_density: margin pressure; compressed margins; gross margin decline; margin compression;
  operating margin declined; pricing pressure; inflationary pressures; lower gross margins; margin headwinds;
  cost inflation; input cost inflation; higher input costs; freight costs; labor costs increased; discounting;
  promotional activity; mix shift; gross margin decreased; gross margin contracted; input cost pressures
liquidity_constraint_density: liquidity constraint; cash constraint; cash shortfall; cash burn; cash requirements;
  debt maturity; covenant pressure; refinancing risk; working capital; working capital deficit;
  negative working capital; cash runway; additional financing; need to raise capital; substantial doubt;
  debt service; near-term maturities; credit facility availability; borrowing base; covenant compliance;
  restricted cash; liquidity covenant; minimum liquidity
""")

# Topics of the diff.
TOPICS = _named("""
legal/regulatory: litigation; lawsuit; regulatory enforcement; regulatory investigation; regulatory inquiry;
  enforcement action; investigation; subpoena; civil penalty; settlement; civil investigative demand; wells notice;
  consent order; consent decree; cease and desist; class action complaint
liquidity: liquidity; cash shortfall; cash burn; cash requirements; liquidity position; refinancing; covenant;
  going concern; working capital; working capital deficit; negative working capital; cash runway;
  need to raise capital; debt service; near-term maturities; credit facility availability; borrowing base;
  restricted cash
supply chain: supplier; supply chain; supply chain disruption; supply chain disruptions; sourcing; vendor;
  single-source supplier; sole supplier; supplier concentration; semiconductor inventory
cybersecurity: cybersecurity; cyber incident; cybersecurity incident; cybersecurity breach; security incident;
  security breach; ransomware; data breach; ransomware attack; data exfiltration; network intrusion;
  unauthorized access
customer concentration: major customer; customer concentration; largest customer; significant customer;
  top customer; revenue concentration
supplier concentration: sole supplier; single supplier; supplier concentration; single-source supplier
macroeconomic: recession; inflation; macroeconomic; economic downturn
interest rate: interest rate; interest rates; borrowing cost; borrowing costs; rate hikes; variable-rate debt;
  net interest margin
fx: foreign exchange; foreign currency; foreign currency fluctuations; currency exchange; exchange rate; fx
commodity: commodity; commodities; raw material; raw material costs
competition: competition; competitor
product/platform: product defect; product liability; product launch delay; platform outage; technology failure
operational: operational disruption; manufacturing disruption; manufacturing disruptions; production delay;
  facility closure
ai/data/privacy: artificial intelligence; machine learning; privacy law; consumer data; data processing; model risk
tax: tax audit; tax examination; uncertain tax position; transfer pricing
credit/default: credit deterioration; delinquency; nonperforming; charge-off; chargeoff
banking/capital: capital ratio; risk-weighted assets; liquidity coverage ratio; stress capital buffer
real estate: occupancy; lease termination; tenant default; cap rate
healthcare/regulatory: fda approval; clinical trial; reimbursement; cms
accounting/internal controls: internal control; internal control over financial reporting; material weakness;
  restatement
geopolitical: geopolitical; sanctions; tariff; trade war
climate: climate-related; climate risk; carbon; emissions; emissions regulations; sustainability
labor: labor shortage; workforce reduction; strike; strikes
""")

# Event flags, what suppresses them, and where they count.
FLAG_PATTERNS = _named("""
material_weakness_flag: material weakness; material weaknesses;
  material weakness in internal control over financial reporting;
  material weaknesses in internal control over financial reporting
significant_deficiency_flag: significant deficiency; significant deficiencies
ineffective_controls_flag: not effective; ineffective internal control;
  disclosure controls and procedures were not effective; disclosure controls and procedures are not effective;
  disclosure controls and procedures were ineffective; internal control over financial reporting was not effective;
  management concluded that our internal control over financial reporting was ineffective
restatement_flag: restatement; restated; revision of previously issued; will restate its financial statements
non_reliance_flag: should no longer be relied upon; non-reliance;
  previously issued financial statements should no longer be relied upon; audit committee concluded
auditor_change_flag: change in certifying accountant; resignation of our independent
investigation_flag: investigation; subpoena; received a subpoena; subpoena from; inquiry by the sec;
  regulatory inquiry; regulatory investigation; civil investigative demand; wells notice;
  department of justice investigation
settlement_flag: settlement; consent decree; civil penalty; consent order; cease and desist; settled with the sec
material_legal_proceeding_flag: material legal proceeding; material litigation; class action complaint;
  enforcement action
going_concern_flag: going concern; continue as a going concern; substantial doubt about our ability;
  substantial doubt exists; ability to continue as a going concern;
  unable to meet obligations as they become due; substantial doubt has not been alleviated;
  plans are intended to mitigate
covenant_breach_flag: covenant breach; default under; event of default; default under our credit agreement;
  violation of covenants; breach of covenant; failed to comply with covenants;
  failed to comply with financial covenants; breach of financial covenant; waiver from lenders;
  forbearance agreement; accelerated repayment; liquidity shortfall; insufficient liquidity; unable to refinance
guidance_withdrawal_flag: withdraw our guidance; withdraws guidance; withdrawing guidance; suspend guidance;
  suspended guidance; suspending guidance; no longer providing guidance; does not expect to provide guidance;
  unable to provide guidance; no longer expects
cybersecurity_incident_flag: material cybersecurity incident; cybersecurity incident; cyber incident;
  security incident; ransomware; ransomware attack; data breach; unauthorized access; data exfiltration;
  data compromise; network intrusion; business email compromise; personal information was accessed;
  reasonably likely material impact; incident response; systems outage
""")
FLAG_SUPPRESSIONS = _named("""
material_weakness_flag: no material weakness; no material weaknesses; did not identify any material weakness;
  did not identify a material weakness; no material weaknesses were identified
going_concern_flag: substantial doubt has been alleviated; alleviated substantial doubt
cybersecurity_incident_flag: board oversight; annual training; cybersecurity program includes
investigation_flag: routine regulatory examination; periodic examination; routine regulatory examinations
covenant_breach_flag: default settings; default rate
""")
_CONTROLS = _terms("item_9a_controls; item_4_controls; item_1a_risk_factors")
_LEGAL = _terms("item_1a_risk_factors; item_3_legal_proceedings; item_1_legal_proceedings; item_1_01; item_1_05; item_8_01")
_FUNDING = _terms("item_1a_risk_factors; item_7_mdna; item_2_mdna; item_1_01; item_8_01")
FLAG_SCOPES = {
    **dict.fromkeys(("material_weakness_flag", "significant_deficiency_flag", "ineffective_controls_flag", "restatement_flag", "non_reliance_flag", "auditor_change_flag"), _CONTROLS),
    **dict.fromkeys(("investigation_flag", "settlement_flag", "material_legal_proceeding_flag"), _LEGAL),
    **dict.fromkeys(("going_concern_flag", "covenant_breach_flag"), _FUNDING),
    "guidance_withdrawal_flag": _terms("item_7_mdna; item_2_mdna; item_2_02"),
    "cybersecurity_incident_flag": _terms("item_1c_cybersecurity; item_1_05; item_8_01; item_1a_risk_factors"),
}

# Sections. (item number, fragment of the title) by section; patterns over lower-cased text by form.
HEADINGS = {
    "item_1a_risk_factors": ("1A", "risk factors"),
    "item_1c_cybersecurity": ("1C", "cybersecurity"),
    "item_3_legal_proceedings": ("3", "legal proceedings"),
    "item_7_mdna": ("7", "management"),
    "item_7a_market_risk": ("7A", "quantitative"),
    "item_9a_controls": ("9A", "controls"),
    "item_1_legal_proceedings": ("1", "legal proceedings"),
    "item_2_mdna": ("2", "management"),
    "item_4_controls": ("4", "controls"),
    "item_1_01": ("1.01", ""),
    "item_1_05": ("1.05", ""),
    "item_2_02": ("2.02", ""),
    "item_5_02": ("5.02", ""),
    "item_8_01": ("8.01", ""),
}
FORM_PATTERNS = {
    "10-K": {
        "item_1a_risk_factors": r"(?:item\s*)?1a\.?[^a-z]{0,40}risk\s*factors",
        "item_3_legal_proceedings": r"(?:item\s*)?3\.?[^a-z]{0,40}legal\s*proceedings",
        "item_7_mdna": r"(?:item\s*)?7\.?[^a-z]{0,40}management",
        "item_7a_market_risk": r"(?:item\s*)?7a\.?[^a-z]{0,40}quantitative",
        "item_9a_controls": r"(?:item\s*)?9a\.?[^a-z]{0,40}controls",
        "item_1c_cybersecurity": r"(?:item\s*)?1c\.?[^a-z]{0,40}cybersecurity",
    },
    "10-Q": {
        "item_1a_risk_factors": r"item\s*1a\.?\s*risk\s*factors",
        "item_2_mdna": r"item\s*2\.?\s*management",
        "item_1_legal_proceedings": r"item\s*1\.?\s*legal\s*proceedings",
        "item_4_controls": r"item\s*4\.?\s*controls",
    },
    "8-K": {
        "item_1_01": r"item\s*1\.01",
        "item_1_05": r"item\s*1\.05(?:[^a-z]{0,80}material\s*cybersecurity\s*incidents)?",
        "item_2_02": r"item\s*2\.02",
        "item_5_02": r"item\s*5\.02",
        "item_8_01": r"item\s*8\.01",
    },
}
REQUIRED_SECTIONS = {"10-K": ("item_1a_risk_factors", "item_7_mdna"), "10-Q": ("item_1a_risk_factors", "item_2_mdna"), "8-K": ("item_2_02",)}
MDNA_SECTIONS = ("item_7_mdna", "item_2_mdna")


@dataclass(frozen=True)
class TermPacks:
    """All packs that metrics, flags, densities and topics read."""

    negative: tuple[str, ...] = NEGATIVE
    uncertainty: tuple[str, ...] = UNCERTAINTY
    litigious: tuple[str, ...] = LITIGIOUS
    constraining: tuple[str, ...] = CONSTRAINING
    weak_modal: tuple[str, ...] = WEAK_MODAL
    moderate_modal: tuple[str, ...] = MODERATE_MODAL
    strong_modal: tuple[str, ...] = STRONG_MODAL
    severity: tuple[str, ...] = SEVERITY
    boilerplate: tuple[str, ...] = BOILERPLATE
    legal: tuple[str, ...] = LEGAL_REGULATORY
    geography: tuple[str, ...] = GEOGRAPHY
    segment: tuple[str, ...] = SEGMENT
    densities: dict[str, tuple[str, ...]] = field(default_factory=lambda: DENSITIES)
    topics: dict[str, tuple[str, ...]] = field(default_factory=lambda: TOPICS)
    flag_patterns: dict[str, tuple[str, ...]] = field(default_factory=lambda: FLAG_PATTERNS)
    flag_suppressions: dict[str, tuple[str, ...]] = field(default_factory=lambda: FLAG_SUPPRESSIONS)
    flag_scopes: dict[str, tuple[str, ...]] = field(default_factory=lambda: FLAG_SCOPES)

    @property
    def modal(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(self.weak_modal + self.moderate_modal + self.strong_modal))


def form_base(form_type: str) -> str:
    """The form without its amendment mark; unknown forms are read like a 10-K."""
    base = form_type.replace("/A", "").replace("-A", "").upper()
    return base if base in FORM_PATTERNS else "10-K"
