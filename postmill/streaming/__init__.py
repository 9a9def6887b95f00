"""Incremental runs over folders that keep receiving files (an extra: archives are otherwise read at once)."""
