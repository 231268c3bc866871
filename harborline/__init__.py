"""Monthly trade-statistics analytics as DataFrame plans."""
