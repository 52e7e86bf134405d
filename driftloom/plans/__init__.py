"""driftloom.plans"""
