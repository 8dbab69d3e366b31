"""twinproof: reconcile what two sources say about the same entity, on Spark."""

from twinproof.profile import FieldPolicy, Profile, TRUST_FUND, load_profile
from twinproof.session import get_spark, shared_dir

__all__ = ["FieldPolicy", "Profile", "TRUST_FUND", "load_profile", "get_spark", "shared_dir"]
