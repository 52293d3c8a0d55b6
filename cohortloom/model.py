"""Study tables and configuration."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

KEYS = ("PATNO", "EVENT_ID")
TARGET = "COHORT"
MODALITIES = ("subject_characteristics", "medical_history", "motor_assessments", "non_motor_assessments", "biospecimen")
# The labels, names and thresholds that results depend on.
COHORTS = ("Parkinson's Disease", "Prodromal", "Healthy Control", "SWEDD")
COHORT_SYNONYMS = {"PD": "Parkinson's Disease", "CONTROL": "Healthy Control"}
METADATA_COLUMNS = ("REC_ID", "ORIG_ENTRY", "LAST_UPDATE", "PAG_NAME", "QUERY_ID", "QUERY_TEXT")
ENCODING_IGNORED = ("PATNO", "EVENT_ID", "COHORT", "PAG_NAME", "REC_ID", "INFODT", "ORIG_ENTRY", "LAST_UPDATE", "SITE_APRV", "GUID", "APPRDX", "PRIMDIAG")
OTHER_BUCKET = "_OTHER_"


@dataclass(frozen=True, order=True)
class TableKey:
    modality: str
    table: str | None = None

    @property
    def report_key(self) -> str:
        return f"{self.modality}.{self.table}" if self.table else self.modality

    @property
    def prefix(self) -> str:
        return f"{self.modality}_{self.table}" if self.table else self.modality


@dataclass(frozen=True)
class Study:
    """Tables by key, in the order given; nested dictionaries flatten one level."""

    tables: dict[TableKey, DataFrame] = field(default_factory=dict)

    @staticmethod
    def of(nested: dict) -> Study:
        flat = {}
        for modality, value in nested.items():
            if isinstance(value, dict):
                flat |= {TableKey(modality, t): df for t, df in value.items()}
            else:
                flat[TableKey(modality)] = value
        return Study(flat)

    def map(self, f) -> Study:
        return Study({k: f(k, df) for k, df in self.tables.items()})


@dataclass(frozen=True)
class ReducerConfig:
    missing_threshold: float = 0.95
    single_value_threshold: float = 1.0
    low_variance_std: float = 0.01
    high_cardinality_ratio: float = 0.9
    check_variance: bool = True
    check_cardinality: bool = False
    metadata_columns: tuple[str, ...] = METADATA_COLUMNS
    keys: tuple[str, ...] = KEYS

    def override(self, **values) -> ReducerConfig:
        return replace(self, **values)


# Names of features that give the diagnosis away, for runs without a list of their own.
LEAKAGE_FEATURES = (
    "PATNO",
    "EVENT_ID",
    "medical_history_Features_of_Parkinsonism_PSGLVL",
    "subject_characteristics_ENRLSRDC",
    "motor_assessments_PDTRTMNT",
    "motor_assessments_PDTRTMNT_x_orig",
    "motor_assessments_PDTRTMNT_y_orig",
    "subject_characteristics_SCREENEDAM4",
    "motor_assessments_NUPSOURC_x_orig",
    "motor_assessments_DBSYN",
    "motor_assessments_DBSYN_x_orig",
    "motor_assessments_DBSYN_y_orig",
    "subject_characteristics_PISTDY",
    "subject_characteristics_APPRDX",
    "motor_assessments_PDMEDYN",
    "motor_assessments_PDMEDYN_x_orig",
    "motor_assessments_PDMEDYN_y_orig",
    "medical_history_Clinical_Diagnosis_NEWDIAG",
    "subject_characteristics_PATHVAR_COUNT",
    "subject_characteristics_ENRLPRKN",
    "subject_characteristics_ENRLLRRK2",
    "subject_characteristics_RNASEQ_VIS",
    "medical_history_Features_of_Parkinsonism_FEATBRADY",
    "subject_characteristics_AV133STDY",
    "biospecimen_standard_files_PLASPNDR",
    "subject_characteristics_chr12:40340400:G:A_A_LRRK2_G2019S_rs34637584",
    "medical_history_Other_Clinical_Features_FEATCLRLEV",
    "biospecimen_standard_files_BSSPNDR",
    "medical_history_PD_Diagnosis_History_DXRIGID",
    "medical_history_Features_of_Parkinsonism_FEATRIGID",
    "subject_characteristics_chr12:40310434:C:G_G_LRRK2_R1441G_rs33939927",
    "subject_characteristics_chr1:155235252:A:G_G_GBA_L444P_rs421016",
    "medical_history_Features_of_Parkinsonism_FEATTREMOR",
    "medical_history_Neurological_Exam_CORDRSP",
    "motor_assessments_MSEADLG",
    "non_motor_assessments_PARKISM",
    "subject_characteristics_GAITSTDY",
    "medical_history_PD_Diagnosis_History_DXOTHSX",
    "subject_characteristics_ENRLGBA",
    "subject_characteristics_SV2ASTDY",
    "motor_assessments_NP4TOT_x_orig",
    "non_motor_assessments_NQCOG01",
    "motor_assessments_NQUEX33",
    "biospecimen_standard_files_PLASPNRT",
    "medical_history_Determination_of_Freezing_and_Falls_FRZGT12M",
    "biospecimen_standard_files_BSSPNRT",
    "motor_assessments_NQUEX28",
    "subject_characteristics_chr4:89828149:C:T_T_SNCA_A53T_rs104893877",
    "subject_characteristics_chr1:155235843:T:C_C_GBA_N370S_rs76763715",
    "medical_history_Features_of_Parkinsonism_FEATPOSINS",
    "medical_history_Other_Clinical_Features_FEATDCRARM",
    "biospecimen_standard_files_PLAALQN",
    "medical_history_Other_Clinical_Features_FEATDELHAL",
    "non_motor_assessments_PTCGBOTH_y_orig1",
    "motor_assessments_NQMOB33",
    "subject_characteristics_chr1:155240660:G:GC_GC_GBA_84GG_rs387906315",
    "subject_characteristics_chr12:40320043:G:C_C_LRRK2_R1628P/H_rs33949390",
)
