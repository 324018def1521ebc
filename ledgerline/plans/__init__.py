"""From parsed statements to resolved ones, and the explainable scan pattern."""
